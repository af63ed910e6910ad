"""Extension points: engines, plug-ins on transcripts, and a recogniser for tests."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SpeechToText(Protocol):
    def transcribe(self, samples: list[float], rate: int, language: str | None) -> list[dict]: ...


class Diarizer(Protocol):
    def turns(self, samples: list[float], rate: int, speakers: int | None) -> list[dict]: ...


class LanguageModel(Protocol):
    def complete(self, prompt: str) -> str: ...


#: Texts whose results a task holds at a time.
ROWS = 1000
_PLUGINS: dict[str, Callable[[str], Any]] = {}


def plugin(name: str) -> Callable:
    """Registers a function from a call's text to a JSON-like value, or None for no result."""

    def add(f: Callable[[str], Any]) -> Callable[[str], Any]:
        _PLUGINS[name] = f
        return f

    return add


def run_plugins(texts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(call_id, plugin, payload, error): each plug-in on each text; a failing one spoils no other."""
    chosen = {n: _PLUGINS[n] for n in (names or sorted(_PLUGINS))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part, out = batch.slice(start, ROWS), []
                for call, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    for name, f in chosen.items():
                        try:
                            value = f(text.as_py())
                            if value is not None:
                                out.append((call, name, json.dumps(value, sort_keys=True), None))
                        except Exception as e:  # a plug-in may do anything
                            out.append((call, name, None, f"{type(e).__name__}: {e}"[:200]))
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.string()] * 3), strict=True)], ["call_id", "plugin", "payload", "error"])

    return texts.select("call_id", "text").mapInArrow(run, "call_id bigint, plugin string, payload string, error string")


@plugin("word_count")
def _word_count(text: str) -> dict:
    return {"words": len(text.split())}


# What the recogniser for tests hears.
PHRASES = {
    "he": ("שלום", "במה", "אפשר", "לעזור", "לך", "היום"),
    "ru": ("Здравствуйте", "у", "меня", "вопрос", "по", "заказу"),
    "en": ("Hello", "how", "can", "I", "help", "you", "today"),
    "": ("sample", "transcription", "word", "stream"),
}


def mock_words(calls: DataFrame) -> DataFrame:
    """Words spread evenly over each call's ``duration_ms`` by its ``language``, 200 ms apart at least."""
    phrases = F.lit(None).cast("array<string>")
    for lang, ws in PHRASES.items():
        if lang:
            phrases = F.when(F.col("language") == lang, F.array(*[F.lit(w) for w in ws])).otherwise(phrases)
    phrases = F.coalesce(phrases, F.array(*[F.lit(w) for w in PHRASES[""]]))
    step = F.greatest(F.call_function("div", F.col("duration_ms"), F.size("ws").cast("bigint")), F.lit(200))
    rows = calls.withColumn("ws", phrases).withColumn("step", step)
    rows = rows.select("call_id", "duration_ms", "step", F.posexplode("ws").alias("pos", "word"))
    return rows.select("call_id", "pos", "word", (F.col("pos") * F.col("step")).alias("start_ms"), F.least((F.col("pos") + 1) * F.col("step") - 50, "duration_ms").alias("end_ms"))
