"""Quality rules: counted base rules, and divergence from language references with length guards."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .minhash import WORDS_KEPT, WordHashes, mix

SYMBOLS = "#*$%&|<>"
#: Character classes, by UTF-8 byte; the bytes after a character's first one count for none.
CLASSES = ("lower", "upper", "digit", "blank", "stop", "symbol", "other ascii", "beyond ascii")
_CLASS = np.full(256, 8, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in " \t\n\x0b\x0c\r" else 4 if _c in ".,;:!?'\"()-" else 5 if _c in SYMBOLS else 6
_CLASS[0xC0:] = 7
_STOPS = b".,;:!?'\"()-"


@dataclass(frozen=True)
class Rules:
    """The base rules' limits, and those of the divergence rules.

    A document's distance to its language's reference is the square root of the
    Jensen-Shannon divergence in bits, 0 to 1. It is judged only if it has
    ``min_words`` words and its language's reference rests on ``min_reference``.
    A few words always lie farther from a reference: the words' limit is
    ``max_word`` + ``short`` / sqrt(words). References of up to
    ``most_languages`` languages go to all tasks (about 5 KB each); more are
    joined to the documents.
    """

    base_words: int = 50
    base_repeat: int = 50
    common: int = 100
    min_words: int = 50
    min_reference: int = 1000
    most_languages: int = 1000
    max_char: float = 0.30
    max_word: float = 0.42
    short: float = 1.0


RULES = Rules()


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9)[:8]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """The Jensen-Shannon distance of two histograms, 0 (alike) to 1 (nothing shared); 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = sum(float(np.where(x > 0, x * np.log2(x / m), 0.0).sum()) for x in (p, q)) / 2
    return float(np.sqrt(max(d, 0.0)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n): character classes and lower-cased words without stops at their ends."""
    found: dict[str | None, Counter] = {}
    classes: dict[str | None, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        out = []
        for lang, words in found.items():
            clean = Counter()
            for w, n in words.items():
                clean[w.strip(_STOPS)] += n
            clean.pop(b"", None)
            out += [(lang, "word", w.decode("utf-8", "replace"), n) for w, n in clean.items()]
        out += [(lang, "class", CLASSES[k], int(n)) for lang, c in classes.items() for k, n in enumerate(c) if n]
        found.clear()
        classes.clear()
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["lang", "kind", "key", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            found.setdefault(lang, Counter()).update(raw.lower().split())
            classes[lang] = classes.get(lang, 0) + class_counts(raw)
        if sum(map(len, found.values())) > WORDS_KEPT // 2:
            yield flush()
    yield flush()


def references(docs: DataFrame, rules: Rules = RULES, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row for each language with a large enough reference: ``lang``, ``classes``, ``words`` and ``counts`` (of these and of all others).

    The counts are over all documents, summed in Spark. The most common words
    are found in parts: first of each of many, then of these; the rest is
    summed. Equally common words go by their letters.
    """
    docs = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    counts = docs.mapInArrow(_counted, "lang string, kind string, key string, n bigint").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("part", F.when(F.col("kind") == "word", F.pmod(F.xxhash64("key"), F.lit(512))).otherwise(-1))
    part = Window.partitionBy("lang", "kind", "part").orderBy(F.desc("n"), "key")
    counts = counts.withColumn("r", F.row_number().over(part)).withColumn("key", F.when((F.col("kind") == "class") | (F.col("r") <= rules.common), F.col("key")))
    counts = counts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    last = Window.partitionBy("lang", "kind").orderBy(F.col("key").isNull(), F.desc("n"), "key")
    counts = counts.withColumn("r", F.row_number().over(last)).withColumn("key", F.when((F.col("kind") == "class") | (F.col("r") <= rules.common), F.col("key")))
    counts = counts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"), F.min("r").alias("r"))
    of = lambda kind: F.when(F.col("kind") == kind, F.struct("r", "key", "n"))
    rows = counts.groupBy("lang").agg(F.array_sort(F.collect_list(of("word"))).alias("w"), F.collect_list(of("class")).alias("c"))
    found = F.map_from_entries(F.transform("c", lambda x: F.struct(x["key"], x["n"])))
    classes = F.array(*[F.coalesce(F.get(F.map_values(F.map_filter(found, _is(c))), F.lit(0)), F.lit(0).cast("bigint")) for c in CLASSES])
    named = F.filter("w", lambda x: x["key"].isNotNull())
    rest = F.aggregate(F.filter("w", lambda x: x["key"].isNull()), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    rows = rows.select("lang", classes.alias("classes"), F.transform(named, lambda x: x["key"]).alias("words"), F.concat(F.transform(named, lambda x: x["n"]), F.array(rest)).alias("counts"))
    return rows.where(F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x) >= rules.min_reference)


def _is(name: str):
    return lambda k, v: k == name


#: A language's reference: class counts, {word: place}, and the words' counts with the rest's behind them.
Reference = tuple[np.ndarray, dict[str, int], np.ndarray]


def reference_of(classes: list[int], words: list[str], counts: list[int]) -> Reference:
    return np.array(classes, np.int64), {w: k for k, w in enumerate(words)}, np.array(counts, np.int64)


class _Places(dict):
    """A raw word's place among a language's common words; the last place is the rest's."""

    def __init__(self, places: dict[str, int]) -> None:
        super().__init__()
        self.known, self.rest = {w.encode(): k for w, k in places.items()}, len(places)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT // 4:
            self.clear()
        k = self[word] = self.known.get(word.lower().strip(_STOPS), self.rest)
        return k


_HASHES = WordHashes()


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    w = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])
    _, inverse, n = np.unique(w, return_inverse=True, return_counts=True)
    again = n[inverse] > 1
    cover = np.zeros(len(words), bool)
    for k in range(3):
        cover[k : k + len(w)] |= again
    return int(cover.sum())


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def judged(text: str | None, reference: Reference | None, places: dict, rules: Rules = RULES) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, repeat = len(words), repeated_words(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    base = n < rules.base_words or 100 * repeat > rules.base_repeat * n
    char = word = None
    if reference is not None and n >= rules.min_words and reference[2].sum() >= rules.min_reference:
        char = round(distance(class_counts(raw), reference[0]), 6)
        own = np.bincount(np.fromiter(map(places.__getitem__, words), np.int64, n), minlength=len(reference[2]))
        word = round(distance(own, reference[2]), 6)
    kept = not base and (char is None or (char <= rules.max_char and word <= rules.max_word + rules.short / n**0.5))
    return n, chars, sum(text.count(c) for c in SYMBOLS), repeated_lines(raw), repeat, base, char, word, kept


VERDICT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, char_distance double, word_distance double, kept boolean"


def quality(docs: DataFrame, rules: Rules = RULES, text_col: str = "text", lang_col: str = "lang", verdict: str = "verdict") -> DataFrame:
    """``docs`` with a struct column ``verdict`` (the fields of VERDICT).

    Base rules: fewer than ``base_words`` words, or over ``base_repeat`` per
    cent of the words in repeated 3-word windows. Divergence rules: the
    Jensen-Shannon distance of the character classes, and of the common words,
    to the reference of the document's language over all of ``docs``. Too short
    a document, or a language with too small a reference, is not judged by
    divergence (null distances). A null text has no words and fails; null
    languages share one reference, equally common words are in it by their
    letters; a very long text is counted whole. Repeated
    rows get equal verdicts and each count in the reference; an empty table
    gives an empty one. Other columns pass through; the new one gets a number
    if there is one of its name.
    """
    verdict, lang, classes, words, counts = fresh(docs.columns, verdict, "ref_lang", "ref_classes", "ref_words", "ref_counts")
    refs = references(docs, rules, text_col, lang_col)
    first = refs.take(rules.most_languages + 1)
    fields = T.StructType.fromDDL(VERDICT)
    arrow = pa.struct([pa.field(f.name, {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.dataType.simpleString()]) for f in fields])
    (of_text, of_lang), width = (docs.columns.index(c) for c in (text_col, lang_col)), len(docs.columns)
    known = None
    rows = docs
    if len(first) <= rules.most_languages:
        known = {r.lang: reference_of(r.classes, r.words, r.counts) for r in first}
    else:
        refs = refs.select(F.col("lang").alias(lang), F.col("classes").alias(classes), F.col("words").alias(words), F.col("counts").alias(counts))
        rows = docs.join(refs, F.col(f"`{lang_col}`").cast("string").eqNullSafe(F.col(lang)), "left").drop(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def reference(lang: str | None, batch: pa.RecordBatch, k: int) -> tuple[Reference | None, dict]:
            if lang not in held:
                if len(held) > 2 * rules.most_languages:
                    held.clear()
                found = known.get(lang) if known is not None else None
                if known is None and batch.column(width)[k].is_valid:
                    found = reference_of(*[batch.column(width + i)[k].as_py() for i in range(3)])
                held[lang] = found, _Places(found[1]) if found else {}
            return held[lang]

        for batch in batches:
            langs = batch.column(of_lang).cast(pa.string()).to_pylist()
            out = [judged(t.as_py(), *reference(x, batch, k), rules) for k, (t, x) in enumerate(zip(batch.column(of_text), langs, strict=True))]
            cols = list(zip(*out, strict=True)) or [()] * len(fields)
            added = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], fields=list(arrow))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], added], [*batch.schema.names[:width], verdict])

    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(verdict, fields)]))


def good_documents(docs: DataFrame, rules: Rules = RULES, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps; the columns are those of ``docs``."""
    (verdict,) = fresh(docs.columns, "verdict")
    return quality(docs, rules, text_col, lang_col, verdict).where(F.col(f"`{verdict}`.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """``quality`` over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality(docs).select("doc_id", "verdict.*")


_KEY = f"trim(translate({{0}}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_STOPS.decode().replace(chr(39), chr(39) * 2)}')"
_SQL_CLASSES = {
    "lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "blank": r"[\x20\x09-\x0D]", "stop": r"[.,;:!?\x27\x22()-]", "symbol": "[#*$%&|<>]",
    "other ascii": r"[\x00-\x08\x0E-\x1F+/=@\x5B-\x60{}~\x7F]", "beyond ascii": r"[^\x00-\x7F]",
}
_TERM = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END"
#: The query in SQL: base counts, references over all documents, both distances.
OP8_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, lang, unnest(w) AS w, unnest(range(len(w))) AS pos FROM d),
grams AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (
  SELECT doc_id, unnest(range(len(w) - 2)) AS pos, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d WHERE len(w) > 2)),
again AS (SELECT doc_id, count(DISTINCT covered) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS covered FROM grams WHERE times > 1) GROUP BY 1),
base AS (
  SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_dup_lines,
    coalesce(again.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN again USING (doc_id)),
own_class AS (SELECT doc_id, lang, unnest({list(_SQL_CLASSES)}) AS k, unnest([{", ".join(f"len(regexp_extract_all(text, '{c}'))" for c in _SQL_CLASSES.values())}]) AS n FROM d),
ref_class AS (SELECT lang, k, sum(n) AS n FROM own_class GROUP BY ALL),
char_d AS (
  SELECT doc_id, sqrt(greatest(sum({_TERM.format("p", "q")} + {_TERM.format("q", "p")}) / 2, 0)) AS d FROM (
    SELECT o.doc_id, o.n / sum(o.n) OVER (PARTITION BY o.doc_id) AS p, r.n / sum(r.n) OVER (PARTITION BY o.doc_id) AS q
    FROM own_class o JOIN ref_class r ON o.lang IS NOT DISTINCT FROM r.lang AND o.k = r.k) GROUP BY 1),
keyed AS (SELECT doc_id, lang, {_KEY.format("w")} AS k FROM w),
counts AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, k) AS r FROM (SELECT lang, k, count(*) AS n FROM keyed WHERE k <> '' GROUP BY ALL)),
ref AS (SELECT lang, CASE WHEN r <= {RULES.common} THEN k ELSE '' END AS k, sum(n) AS n FROM counts GROUP BY ALL),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS q, sum(n) OVER (PARTITION BY lang) AS total FROM ref),
own AS (
  SELECT doc_id, lang, k, count(*) AS n FROM (
    SELECT doc_id, keyed.lang, CASE WHEN s.k IS NULL THEN '' ELSE keyed.k END AS k
    FROM keyed LEFT JOIN (SELECT lang, k FROM ref WHERE k <> '') s ON s.lang IS NOT DISTINCT FROM keyed.lang AND s.k = keyed.k) GROUP BY ALL),
word_d AS (
  -- what only the reference has adds its own share
  SELECT doc_id, sqrt(greatest((sum({_TERM.format("p", "q")} + {_TERM.format("q", "p")}) + 1 - sum(q)) / 2, 0)) AS d FROM (
    SELECT o.doc_id, o.n / sum(o.n) OVER (PARTITION BY o.doc_id) AS p, coalesce(s.q, 0) AS q
    FROM own o LEFT JOIN shares s ON s.lang IS NOT DISTINCT FROM o.lang AND s.k = o.k) GROUP BY 1),
total AS (SELECT lang, any_value(total) AS total FROM shares GROUP BY 1),
f AS (
  SELECT base.*, n_words < {RULES.base_words} OR 100 * n_repeat_words > {RULES.base_repeat} * n_words AS base_failed,
    CASE WHEN n_words >= {RULES.min_words} AND total >= {RULES.min_reference} THEN round(c.d, 6) END AS char_distance,
    CASE WHEN n_words >= {RULES.min_words} AND total >= {RULES.min_reference} THEN round(v.d, 6) END AS word_distance
  FROM base LEFT JOIN total t ON t.lang IS NOT DISTINCT FROM base.lang LEFT JOIN char_d c USING (doc_id) LEFT JOIN word_d v USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance,
  NOT base_failed AND (char_distance IS NULL OR (char_distance <= {RULES.max_char} AND word_distance <= {RULES.max_word} + {RULES.short} / sqrt(n_words))) AS kept
FROM f
"""
