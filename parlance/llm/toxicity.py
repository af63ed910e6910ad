"""Toxicity: a sparse logistic regression whose score may not change when identity terms are swapped.

Features of a text are its lower-cased words, the beginnings of its words
(slurs are inflected), and beginnings that make up a good part of all words.
Weights are fitted with an L1 penalty, so that a very long text gathers no
noise, and with a counterfactual one: each labelled sentence that names a group
is paired with copies that name other groups, or people in general, and squared
differences of the two scores are penalised. A group's name thereby gets the
weight of any other group's, and of none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, fresh, removed, written

#: Terms that may stand for one another in a sentence, by language and form; the last ones name no group.
IDENTITY = tuple(
    tuple(row.split())
    for row in (
        "muslims christians jews hindus buddhists atheists catholics gays lesbians immigrants refugees foreigners africans asians arabs mexicans women men people",
        "muslim christian jewish hindu buddhist atheist catholic gay lesbian queer transgender black white african asian arab mexican chinese deaf blind disabled female male other",
        "woman man girl boy immigrant refugee foreigner person",
        "muslime christen juden hindus buddhisten atheisten schwule lesben ausländer flüchtlinge afrikaner asiaten araber türken frauen männer menschen",
        "muslimisch christlich jüdisch schwul lesbisch schwarz weiß behindert weiblich männlich anders",
        "musulmans chrétiens juifs hindous bouddhistes athées homosexuels lesbiennes immigrés réfugiés étrangers africains asiatiques arabes femmes hommes gens",
        "musulman chrétien juif hindou bouddhiste athée homosexuel noir blanc handicapé étranger autre",
        "musulmanes cristianos judíos hindúes budistas ateos homosexuales lesbianas inmigrantes refugiados extranjeros africanos asiáticos árabes mujeres hombres personas",
        "musulmán cristiano judío hindú budista ateo homosexual negro blanco discapacitado extranjero otro",
    )
)
_ROW = {term: row for row in reversed(IDENTITY) for term in row}


@dataclass(frozen=True)
class Fit:
    """How the model is fitted.

    At most ``most_rows`` labelled rows are used, and ``most_features`` features
    that ``min_rows`` of them have and whose first gradient may pass the L1
    penalty (``l1`` rows' worth, ``least_l1`` at least). ``counterfactual``
    weighs the penalty on swaps, ``swaps`` is how many copies a sentence gets.
    In at most ``rounds`` rounds ``added`` features join, with ``steps`` each.
    """

    most_rows: int = 10_000
    most_features: int = 20_000
    min_rows: int = 3
    l1: float = 1.0
    least_l1: float = 1e-4
    counterfactual: float = 4.0
    swaps: int = 3
    rounds: int = 30
    added: int = 500
    steps: int = 100


FIT = Fit()
#: Lengths of words' beginnings, and the shares of all words that make one dense.
_STARTS = (3, 4, 5, 6)
_DENSE = ((0.02, "+"), (0.05, "++"))
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def starts(word: str) -> list[str]:
    return ["^" + word[:k] for k in _STARTS if len(word) >= k]


def dense(counts: Counter, n: int) -> Iterator[str]:
    for start, k in counts.items():
        for share, mark in _DENSE:
            if k >= 2 and k >= share * n:
                yield start + mark


def features(ws: list[str]) -> set[str]:
    """The features of a text's words."""
    counts, begun = Counter(ws), Counter()
    for w, k in counts.items():
        for s in starts(w):
            begun[s] += k
    return {*counts, *begun, *dense(begun, len(ws))}


def swapped(ws: list[str], swaps: int) -> list[list[str]]:
    """A sentence's words with their identity terms swapped, each as many places on in its row; the last copy names no group."""
    if _ROW.keys().isdisjoint(ws):
        return []
    turned = [[_ROW[w][(_ROW[w].index(w) + k) % len(_ROW[w])] if w in _ROW else w for w in ws] for k in range(1, swaps)]
    return [*turned, [_ROW[w][-1] if w in _ROW else w for w in ws]]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, ws: Iterable[str], known: dict | None = None) -> float:
        """The probability of label 1. ``known`` keeps what words bring from one text to the next."""
        known = {} if known is None else known
        counts = Counter(ws)
        z, seen, begun = self.bias, set(), Counter()
        for w, k in counts.items():
            brings = known.get(w)
            if brings is None:
                if len(known) > 200_000:
                    known.clear()
                begins = starts(w)
                brings = known[w] = ([x for x in (w, *begins) if x in self.weights], [s for s in begins if any(s + m in self.weights for _, m in _DENSE)])
            if brings[0]:
                seen.update(brings[0])
            for s in brings[1]:
                begun[s] += k
        seen.update(x for x in dense(begun, counts.total()) if x in self.weights)
        z += sum(self.weights[x] for x in sorted(seen))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


class _Rows:
    """Sparse rows, as (row, column, value) of their entries: sums of weights for each row, and back."""

    def __init__(self, n: int, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> None:
        self.n, self.row, self.col, self.value = n, row, col, value

    @classmethod
    def of(cls, rows: list[list[int]], values: list[list[float]] | None = None) -> _Rows:
        col = np.array([c for r in rows for c in r], np.int64)
        value = np.ones(len(col)) if values is None else np.array([v for r in values for v in r], float)
        return cls(len(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), col, value)

    def part(self, columns: np.ndarray) -> _Rows:
        """The entries of some columns, numbered anew."""
        place = np.full(max(int(self.col.max(initial=-1)), int(columns.max(initial=-1))) + 1, -1)
        place[columns] = np.arange(len(columns))
        col = place[self.col]
        own = col >= 0
        return _Rows(self.n, self.row[own], col[own], self.value[own])

    def sums(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col] * self.value, self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row] * self.value, size)


def _gradient(x: _Rows, y: np.ndarray, swaps: _Rows, strength: float, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    g = (1 / (1 + np.exp(-np.clip(x.sums(w) + b, -500, 500))) - y) / len(y)
    return x.back(g, len(w)) + strength * swaps.back(swaps.sums(w), len(w)), float(g.sum())


def _stepped(x: _Rows, y: np.ndarray, swaps: _Rows, strength: float, l1: float, w: np.ndarray, b: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient steps from ``w`` and ``b``."""

    def loss(w: np.ndarray, b: float) -> float:
        z = x.sums(w) + b
        return float((np.logaddexp(0, z) - y * z).sum() / len(y) + strength * (swaps.sums(w) ** 2).sum() / 2)

    v, vb, lip, t = w, b, 1.0, 1.0
    for _ in range(steps):
        (gw, gb), at = _gradient(x, y, swaps, strength, v, vb), loss(v, vb)
        while True:
            u = v - gw / lip
            new, nb = np.sign(u) * np.maximum(np.abs(u) - l1 / lip, 0), vb - gb / lip
            dw, db = new - v, nb - vb
            if loss(new, nb) <= at + gw @ dw + gb * db + lip / 2 * (dw @ dw + db * db) + 1e-12:
                break
            lip *= 2
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, vb = new + (before - 1) / t * (new - w), nb + (before - 1) / t * (nb - b)
        w, b, lip = new, nb, lip * 0.9
    return w, b


def solved(rows: list[list[int]], y: list[int], pairs: list[tuple[list[int], list[int]]], size: int, fit: Fit = FIT) -> tuple[np.ndarray, float]:
    """Weights and bias. ``pairs`` are the features that a swap takes and brings.

    Most weights are 0, so steps are taken with the features that matter, to
    which those are added whose gradient passes the penalty, until there are none.
    """
    x, labels = _Rows.of(rows), np.array(y, float)
    swaps = _Rows.of([a + b for a, b in pairs], [[1.0] * len(a) + [-1.0] * len(b) for a, b in pairs])
    l1, strength, mean = penalty(len(y), fit), fit.counterfactual / max(len(pairs), 1), labels.mean()
    w, b, active = np.zeros(size), float(np.log(mean / (1 - mean))), np.zeros(size, bool)
    for _ in range(fit.rounds):
        pull = np.where(active, 0, np.abs(_gradient(x, labels, swaps, strength, w, b)[0]))
        more = np.argsort(-pull, kind="stable")[: fit.added]
        more = more[pull[more] > l1 * 1.001]
        if not len(more):
            break
        active[more] = True
        own = np.flatnonzero(active)
        w[own], b = _stepped(x.part(own), labels, swaps.part(own), strength, l1, w[own], b, fit.steps)
    return w, b


def penalty(n: int, fit: Fit = FIT) -> float:
    return max(fit.l1 / n, fit.least_l1)


def learnable(id_col: str = "doc_id"):
    """Rows that may be learnt from: those whose id's CRC-32 isn't divisible by 5."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 != 0, F.lit(False))


_EXAMPLES = "doc string, y int, kind string, found array<string>, other array<string>"


def examples(rows: DataFrame, fit: Fit = FIT) -> DataFrame:
    """Of (doc, y, text): a row ``text`` with its features, and for each swap a row ``pair`` with the features it takes (``found``) and brings (``other``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, y, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out = [(doc, y, "text", sorted(features(words(text))), None)]
                if not _ROW.keys().isdisjoint(words(text)):
                    for sentence in map(words, _SENTENCE.findall(text)):
                        own = features(sentence)
                        for copy in swapped(sentence, fit.swaps):
                            other = features(copy)
                            out.append((doc, y, "pair", sorted(own - other), sorted(other - own)))
                cols = list(zip(*out, strict=True))
                types = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc", "y", "kind", "found", "other"])

    return rows.mapInArrow(run, _EXAMPLES)


def fitted(docs: DataFrame, labels: DataFrame, fit: Fit = FIT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the learnable rows of ``labels`` (``learnable``), by the texts of ``docs``.

    Labels are rows of an id and 0 or 1; null ones are left out, of several for
    one id the greatest counts, and so does the least of several texts. The
    sample is bounded by ``fit.most_rows``; what comes to the driver are its
    rows' features among ``fit.most_features``. Without rows of both labels the
    score is the same for all texts.
    """
    ids = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(learnable("id") & F.col("y").isNotNull())
    chosen = bounded_sample(ids.groupBy("id").agg(F.max("y").alias("y")), fit.most_rows, F.col("id"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text")).select(F.col("id").cast("string").alias("doc"), "y", "text")
    table = written(examples(texts, fit), "examples")
    try:
        rows = table.where(F.col("kind") == "text")
        n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
        if not 0 < positive < n:
            return Model({}, 4.0 if n and positive else -4.0)
        stats = rows.select("y", F.explode("found").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
        gradient = F.abs(F.col("pos") - F.col("n") * F.lit(positive / n)) / F.lit(n)
        stats = stats.where((F.col("n") >= fit.min_rows) & (gradient >= F.lit(penalty(n, fit))))
        names = [r.f for r in stats.orderBy(gradient.desc(), "f").limit(fit.most_features).collect()]
        place = {f: k for k, f in enumerate(names)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = [[[place[f] for f in x or () if f in place] for x in batch.column(k).to_pylist()] for k in (3, 4)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(x, pa.list_(pa.int32())) for x in lists]], ["doc", "y", "kind", "found", "other"])

        placed = table.mapInArrow(run, "doc string, y int, kind string, found array<int>, other array<int>")
        found = placed.where(F.col("kind") == "text").orderBy("doc").collect()
        pairs = bounded_sample(placed.where((F.col("kind") == "pair") & (F.size("found") + F.size("other") > 0)).select("found", "other"), fit.most_rows, F.col("found"), F.col("other")).collect()
    finally:
        removed(table)
    w, b = solved([r.found for r in found], [r.y for r in found], [(r.found, r.other) for r in pairs], len(names), fit)
    return Model({f: float(w[k]) for k, f in enumerate(names) if w[k]}, b)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score``, the probability that a text is toxic.

    The whole text counts, however long; a null or empty one has the score of
    no words. Repeated rows get equal scores, other columns pass through, and
    the new one gets a number where there is one of its name.
    """
    (score,) = fresh(docs.columns, score)
    of = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            scores = [model.score(words(t.as_py()), known) for t in batch.column(of)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score, by a model of the labels that may be learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
