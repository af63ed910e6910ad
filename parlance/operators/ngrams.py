"""A text's language by its commonest letter trigrams, compared in rank with those of known languages; by its script where that says little."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import script_language
from parlance.operators.calls import fresh_name


@dataclass(frozen=True)
class Ngrams:
    """Ranks of a profile; letters below which, and the lead over the second language (a share of its distance) below which, a text is unsure; distinct words that a task counts at a time."""

    ranks: int = 300
    least_letters: int = 40
    margin: float = 0.03
    held: int = 200_000


NGRAMS = Ngrams()
_LETTERS = re.compile(r"[^\W\d_]+")
#: A language's trigrams and their ranks.
Profiles = dict[str, dict[str, int]]


def trigrams(text: str | None) -> Counter:
    """The letter trigrams of a text's words, with a blank at each end."""
    t = "  ".join(["", *_LETTERS.findall((text or "").lower()), ""])
    out = Counter([t[k : k + 3] for k in range(len(t) - 2)])
    for g in [g for g in out if "  " in g]:  # what lies across two words
        del out[g]
    return out


def ranked(counts: Counter, ranks: int) -> dict[str, int]:
    """The commonest trigrams by rank; equal ones by their letters."""
    order = sorted(counts)
    order.sort(key=counts.__getitem__, reverse=True)  # stable
    return {g: r for r, g in enumerate(order[:ranks])}


def profiles(texts: DataFrame, text: str, language: str, ngrams: Ngrams = NGRAMS) -> Profiles:
    """Of each language its commonest trigrams over all texts that say it: counted in Spark, of which ``ranks`` rows a language come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a language's words are counted first: each is cut once, however often it stands in texts
        words: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            counts: Counter = Counter()
            for lang, held in words.items():
                for word, n in held.items():
                    for k in range(len(word)):
                        counts[lang, f" {word} "[k : k + 3]] += n
            words.clear()
            cols = [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["language", "gram", "n"])

        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words.setdefault(lang, Counter()).update(_LETTERS.findall((t.as_py() or "").lower()))
                if sum(map(len, words.values())) > ngrams.held:
                    yield flush()
        yield flush()

    rows = texts.where(F.col(language).isNotNull()).select(F.col(language).alias("language"), F.col(text).alias("t"))
    counts = rows.mapInArrow(run, "language string, gram string, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    # first the commonest of parts of a language, then of these
    part = Window.partitionBy("language", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(F.desc("n"), "gram")
    some = counts.withColumn("r", F.row_number().over(part)).where(F.col("r") <= ngrams.ranks)
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= ngrams.ranks)
    out: Profiles = {}
    for r in best.collect():
        out.setdefault(r.language, {})[r.gram] = r.r - 1
    return out


def distances(text: str | None, known: Profiles, ngrams: Ngrams = NGRAMS) -> dict[str, float]:
    """Each language's distance, 0 to 1: how far a text's trigrams stand from their ranks there; missing ones count in full."""
    own = ranked(trigrams(text), ngrams.ranks)
    most = ngrams.ranks * max(len(own), 1)
    return {lang: sum(min(abs(r - p[g]), ngrams.ranks) if g in p else ngrams.ranks for g, r in own.items()) / most for lang, p in known.items()}


def judged(text: str | None, known: Profiles, ngrams: Ngrams = NGRAMS) -> tuple[str | None, float | None]:
    """(language, lead) of a text; no language if it has few letters or the lead is small."""
    if sum(map(len, _LETTERS.findall(text or ""))) < ngrams.least_letters or not known:
        return None, None
    order = sorted((d, lang) for lang, d in distances(text, known, ngrams).items())
    lead = 1.0 if len(order) == 1 else min(((b - a) / b if b else 0.0 for (a, _), (b, _) in list(pairwise(order))[:1]), default=0.0)
    return (order[0][1] if lead >= ngrams.margin and order[0][0] < 1 else None), round(lead, 6)


def detected(rows: DataFrame, text: str, known: Profiles, ngrams: Ngrams = NGRAMS, out: str = "language") -> DataFrame:
    """``rows`` with ``language`` (by trigrams, else by script) and ``lead`` (null if there was too little to compare). Texts of any length are read whole."""
    at, out, lead = rows.columns.index(text), fresh_name(rows.columns, out), fresh_name(rows.columns, "lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judged(t.as_py(), known, ngrams) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f for f, _ in found], pa.string()), pa.array([m for _, m in found], pa.float64())], [*batch.schema.names, out, lead])

    done = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType()), T.StructField(lead, T.DoubleType())]))
    return done.withColumn(out, F.coalesce(F.col(out), script_language(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
