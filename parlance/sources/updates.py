"""Updates polled from a far side that numbers them: a stream source with offsets, acknowledgement and backoff.

The far side here is a folder of pages, ``{first}-{last}.jsonl`` with an object
(``update_id`` and anything else) on each line, as a service's answers to
"updates from this number on" would be kept. Pages may overlap and come late.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "update_id bigint, body string"
#: Seconds to wait after a failure: doubled with each further one.
FIRST_WAIT, LONGEST_WAIT = 1.0, 60.0
_ACKNOWLEDGED = "acknowledged"


class Far:
    """The far side: what there is from a number on, and which numbers aren't needed any more."""

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)

    def pages(self) -> list[tuple[int, int, Path]]:
        """(first, last, page) in order; an error if the far side can't be reached."""
        if (self.folder / "down").exists():
            raise ConnectionError("the far side is down")
        out = []
        for p in self.folder.iterdir():
            first, dash, last = p.stem.partition("-")
            if p.suffix == ".jsonl" and dash and first.isdigit() and last.isdigit():
                out.append((int(first), int(last), p))
        return sorted(out)

    def acknowledged(self) -> int:
        try:
            return int((self.folder / _ACKNOWLEDGED).read_text())
        except FileNotFoundError:
            return 0

    def acknowledge(self, following: int) -> None:
        """Everything below ``following`` has been taken."""
        staged = self.folder / f".{_ACKNOWLEDGED}.{os.getpid()}"
        staged.write_text(str(following))
        staged.replace(self.folder / _ACKNOWLEDGED)


class Backoff:
    """When to ask again after failures: 1, 2, 4 and so on up to 60 seconds; a success starts anew."""

    def __init__(self, clock: Callable[[], float] = time.monotonic) -> None:
        self.clock, self.wait, self.next = clock, 0.0, 0.0

    def due(self) -> bool:
        return self.clock() >= self.next

    def failed(self) -> float:
        self.wait = min(max(2 * self.wait, FIRST_WAIT), LONGEST_WAIT)
        self.next = self.clock() + self.wait
        return self.wait

    def succeeded(self) -> None:
        self.wait = self.next = 0.0


class Numbers(InputPartition):
    def __init__(self, first: int, end: int, pages: list[str]) -> None:
        self.first, self.end, self.pages = first, end, pages


class UpdatesReader(DataSourceStreamReader):
    """Offsets are the number that follows the last one taken; a batch is a range of numbers, so a batch that is run again reads the same."""

    def __init__(self, options: dict, clock: Callable[[], float] = time.monotonic) -> None:
        self.far, self.backoff = Far(options["path"]), Backoff(clock)
        self.part = int(options.get("part", 1000))
        self.seen = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": self.far.acknowledged()}

    def latestOffset(self) -> dict:  # noqa: N802
        """What the far side has; while it is unreachable, or not yet to be asked again, what was known before."""
        if self.backoff.due():
            try:
                self.seen = max([self.seen, self.far.acknowledged(), *[last + 1 for _, last, _ in self.far.pages()]])
                self.backoff.succeeded()
            except OSError:
                self.backoff.failed()
        return {"next": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pages = self.far.pages()
        out = []
        for first in range(start["next"], end["next"], self.part):
            stop = min(first + self.part, end["next"])
            held = [str(p) for a, b, p in pages if a < stop and b >= first]
            out += [Numbers(first, stop, held)] if held else []
        return out

    def read(self, partition: Numbers) -> Iterator[tuple]:
        """The updates of a range of numbers, each once, though several pages have it; lines that are no updates are left out."""
        taken: set[int] = set()
        for page in partition.pages:
            with open(page, encoding="utf-8") as lines:
                for line in lines:
                    try:
                        number = json.loads(line)["update_id"]
                    except (ValueError, KeyError, TypeError):
                        continue
                    if isinstance(number, int) and partition.first <= number < partition.end and number not in taken:
                        taken.add(number)
                        yield number, line.rstrip("\n")

    def commit(self, end: dict) -> None:
        try:
            self.far.acknowledge(end["next"])
        except OSError:
            self.backoff.failed()

    def stop(self) -> None:
        pass


class UpdatesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parlance_updates"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return UpdatesReader(self.options)


def updates(spark: SparkSession, folder: str, part: int = 1000) -> DataFrame:
    """The updates in ``folder`` as a stream (SCHEMA), ``part`` numbers to a task.

    A query's checkpoint has its offsets. The far side is told what has been
    taken when the batch behind it begins, so a batch that fails is read again.
    """
    spark.dataSource.register(UpdatesSource)
    return spark.readStream.format("parlance_updates").option("path", folder).option("part", part).load()
