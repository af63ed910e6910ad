"""Full-text search: postings, prefix match, BM25, snippets, and the context of a question."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import query_terms

K1, B = 1.2, 0.75
WORD = r"[\p{L}\p{N}]+"


def _letters_with_marks() -> dict[str, str]:
    """Lower-case letters that are a Latin one with marks, and that letter; letters of other scripts keep theirs."""
    bases = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x1F00)) if c == c.lower()}
    return {c: b for c, b in bases.items() if "a" <= b <= "z" and b != c}


#: Letters with marks and what they are without; marks that stand alone have no counterpart and go.
MARKED = "".join(_letters_with_marks()) + "".join(map(chr, range(0x300, 0x370)))
PLAIN = "".join(_letters_with_marks().values())
_FOLD = str.maketrans(MARKED[: len(PLAIN)], PLAIN, MARKED[len(PLAIN) :])


def folded(c: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def terms_of(c: Column) -> Column:
    return F.regexp_extract_all(folded(c), F.lit(WORD), F.lit(0))


def n_words(c: Column) -> Column:
    """How many ``terms_of`` a text has: as many as before its marks go."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\x{300}-\x{36F}]*+"))


#: Words that a task sorts at once, at least one row's; and letters that it looks through at once for each of them.
MOST_WORDS, LETTERS = 1_000_000, 6
#: What stands for a mark, which goes without ending a word.
_GONE = 0xFFFFFFFF
SIGMA = "\u03a3"


@lru_cache(maxsize=4)
def _letters(spark: SparkSession) -> tuple[tuple[tuple[int, int], ...], tuple[tuple[int, int], ...]]:
    """The ranges of letters and digits, and capitals with their lower case, as the engine knows them: a Python of another Unicode version knows others."""
    every = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").withColumn("c", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32"))
    is_letter = F.col("c").rlike(f"^{WORD}$")
    rows = every.where(is_letter | (F.lower("c") != F.col("c"))).select("id", is_letter.alias("is_letter"), F.ascii(F.translate(F.lower("c"), "".join(map(chr, range(0x300, 0x370))), "")).alias("low")).collect()  # bounded by Unicode
    ids = np.sort([r.id for r in rows if r.is_letter])
    cuts = np.flatnonzero(np.diff(ids) > 1)
    return tuple(zip(ids[np.append(0, cuts + 1)].tolist(), ids[np.append(cuts, len(ids) - 1)].tolist(), strict=True)), tuple((r.id, r.low) for r in rows if r.low not in (r.id, 0))


@lru_cache(maxsize=4)
def _plain(known: tuple[tuple[tuple[int, int], ...], tuple[tuple[int, int], ...]]) -> np.ndarray:
    """For each code point what it is in a word, in lower case without marks: 0 outside of words."""
    letters, capitals = known
    out = np.zeros(0x110000, np.uint32)
    for low, high in letters:
        out[low : high + 1] = np.arange(low, high + 1)
    for c, to in _FOLD.items():
        out[c] = _GONE if to is None else to
    for c, low in capitals:
        out[c] = out[low]
    return out


def _words(texts: list[str], plain: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """How many words each of some texts has, and all of them."""
    at = plain[np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")]
    cell = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)))
    if (gone := at == _GONE).any():
        at, cell = at[~gone], cell[~gone]
    within = at != 0
    begins = within.copy()
    begins[1:] &= ~within[:-1] | (cell[1:] != cell[:-1])
    n, at, first = np.bincount(cell[begins], minlength=len(texts)), at[within], np.flatnonzero(begins[within])
    if not len(at) or at.max() < 0x80:
        data, offsets = at.astype(np.uint8), np.append(first, len(at))
    else:
        data = at.tobytes().decode("utf-32-le").encode()
        width = 1 + (at >= 0x80) + (at >= 0x800) + (at >= 0x10000)
        offsets = np.append((np.cumsum(width) - width)[first], len(data))
    return n, pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def occurrences(rows: DataFrame, kept: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """(kept columns, column, term, tf, first_pos, positions) for each row's words in each column of texts.

    A row's words are counted where it lies and are never shuffled; the rows
    of some thousand texts stand together in the order of their terms. Words
    are those of ``terms_of``, told apart over all letters of a batch at once.
    """
    # what becomes of a capital sigma depends on its neighbours
    text = lambda c: F.when(F.contains(F.col(c), F.lit(SIGMA)), F.lower(c)).otherwise(F.coalesce(F.col(c), F.lit("")))
    texts = rows.select(*kept, *[text(c).alias(c) for c in columns])
    types = {f.name: f.dataType for f in texts.schema.fields}
    schema = T.StructType([*[T.StructField(k, types[k]) for k in kept], *T.StructType.fromDDL("column string, term string, tf bigint, first_pos int, positions array<int>").fields])
    letters, most = _letters(rows.sparkSession), MOST_WORDS * LETTERS

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_words([t.decode("utf-8", "replace") for t in x.cast(pa.binary()).to_pylist()], _plain(letters)) for x in batch.columns[len(kept) :]]
        n, words = np.concatenate([x for x, _ in found]), pa.concat_arrays([x for _, x in found]).dictionary_encode()
        cell = np.repeat(np.arange(len(n)), n)  # a column's row
        pos = (np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        rank = np.empty(len(words.dictionary), np.int64)
        rank[pc.array_sort_indices(words.dictionary).to_numpy()] = np.arange(len(rank))
        code = words.indices.to_numpy(zero_copy_only=False)
        at = rank[code] * max(len(n), 1) + cell
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        tf, cell, code, pos = np.diff(first, append=len(order)), cell[order][first], code[order][first], pos[order]
        row, column = cell % max(batch.num_rows, 1), cell // max(batch.num_rows, 1)
        names = pa.array(columns, pa.string()).take(pa.array(column))
        held = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(pos))
        out = [*[x.take(pa.array(row)) for x in batch.columns[: len(kept)]], names, words.dictionary.take(pa.array(code)), pa.array(tf), pa.array(pos[first]), held]
        return pa.RecordBatch.from_arrays(out, [*kept, "column", "term", "tf", "first_pos", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.sum([pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in columns], axis=0)
            part, start = (np.cumsum(n) - n) // most, 0
            for end in [*(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]:
                yield counted(batch.slice(start, end - start))
                start = end

    return texts.mapInArrow(run, schema)


def repeats(rows: DataFrame, key: str) -> bool:
    """Whether two rows have one key; reads the keys alone."""
    return not rows.groupBy(key).count().where("count > 1").isEmpty()


def postings(docs: DataFrame, columns: tuple[str, ...], key: str = "call_id") -> DataFrame:
    """(key, column, term, tf, first position) for all texts."""
    rows = occurrences(docs.repartition(key), (key,), columns).select(key, "column", "term", "tf", "first_pos")
    if not repeats(docs, key):
        return rows
    return rows.groupBy(key, "column", "term").agg(F.sum("tf").alias("tf"), F.min("first_pos").alias("first_pos"))


def _prefixes(query: str) -> list[str]:
    out = []
    for t in query_terms(query):
        plain = re.sub(r"^[\W_]+|[\W_]+$", "", t.lower().translate(_FOLD))  # as ``folded`` does with texts
        out += [plain] if plain and plain not in out else []
    return out


def matches(docs: DataFrame, query: str, columns: tuple[str, ...], key: str = "call_id") -> DataFrame:
    """Keys whose texts have a word that begins with one of the query's terms; none for an empty query.

    Narrow: no postings are built, each text is looked through where it lies.
    """
    found = F.lit(False)
    for c in columns:
        for p in _prefixes(query):
            found = found | F.exists(terms_of(F.coalesce(F.col(c), F.lit(""))), _begins(p))
    return docs.where(found).select(key)


def _begins(prefix: str):
    return lambda t: t.startswith(prefix)


def bm25(docs: DataFrame, query: str, columns: tuple[str, ...], key: str = "call_id") -> DataFrame:
    """``score`` of each matching document, larger is better.

    A term's tf is the sum over all words that it begins; df counts documents
    with any. Term counts and lengths come from one narrow pass, and the
    corpus's totals are one row.
    """
    prefixes = _prefixes(query)
    if not prefixes:
        return docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    every = F.flatten(F.array(*[terms_of(F.coalesce(F.col(c), F.lit(""))) for c in columns]))
    counts = docs.select(key, every.alias("terms"))
    counts = counts.select(key, F.size("terms").alias("dl"), *[F.size(F.filter("terms", _begins(p))).alias(f"tf{i}") for i, p in enumerate(prefixes)])
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(prefixes))])
    rows = counts.where(" OR ".join(f"tf{i} > 0" for i in range(len(prefixes)))).withColumn("k_", F.lit(1)).join(F.broadcast(stats.withColumn("k_", F.lit(1))), "k_")
    score = F.lit(0.0)
    for i in range(len(prefixes)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.select(key, score.alias("score"))


def snippet(text: Column, query: str, around: int = 8, before: str = "<b>", after: str = "</b>") -> Column:
    """Up to 2 * ``around`` words about the first hit, hits marked; the first words if there is none."""
    prefixes = _prefixes(query)
    ws = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))

    def is_hit(w: Column) -> Column:
        plain = F.regexp_extract(folded(w), WORD, 0)
        out = F.lit(False)
        for p in prefixes:
            out = out | plain.startswith(p)
        return out

    hit = F.array_position(F.transform(ws, is_hit), F.lit(True)).cast("int")
    begin = F.greatest(hit - around, F.lit(1))
    return F.array_join(F.transform(F.slice(ws, begin, 2 * around), lambda w: F.when(is_hit(w), F.concat(F.lit(before), w, F.lit(after))).otherwise(w)), " ")


def searched(docs: DataFrame, calls: DataFrame, query: str, columns: tuple[str, ...], predicate: Column | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """The best hits whose calls meet ``predicate``, with their score."""
    hits = bm25(docs, query, columns).withColumn("score", F.round("score", 6))
    rows = hits.join(calls.withColumnRenamed("id", "call_id"), "call_id")
    rows = rows.where(predicate) if predicate is not None else rows
    return rows.orderBy(F.desc("score"), F.desc("created_at"), "call_id").offset(offset).limit(limit)


def ask_context(docs: DataFrame, question: str, columns: tuple[str, ...], k: int = 5) -> DataFrame:
    """The k best documents numbered as sources, each with its title: what a model would be asked with."""
    from pyspark.sql import Window

    top = bm25(docs, question, columns).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "call_id").limit(k)
    rows = top.join(docs, "call_id").withColumn("source", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "call_id")))
    return rows.select("source", "call_id", "title", "score")


def cited(sources: DataFrame, indexes: list[int] | None) -> DataFrame:
    """Sources that an answer names by number from 1 (0 means the first too), in the order of naming and each call once.

    Numbers beyond the sources don't count; if none is left, or none was given,
    all sources are meant, in their own order. ``place`` is a source's place.
    """
    from pyspark.sql import Window

    named = list(dict.fromkeys(max(1, i) for i in indexes or [] if i >= 0))
    at = F.array_position(F.array(*[F.lit(i) for i in named]), F.col("source").cast("int")) if named else F.lit(0)
    rows = sources.withColumn("at_", at.cast("int"))
    rows = rows.withColumn("any_", F.max("at_").over(Window.partitionBy()))  # as many rows as sources were asked for
    rows = rows.withColumn("place", F.when(F.col("any_") > 0, F.col("at_")).otherwise(F.col("source"))).where("any_ = 0 OR at_ > 0").drop("at_", "any_")
    return rows.withColumn("r_", F.row_number().over(Window.partitionBy("call_id").orderBy("place"))).where("r_ = 1").drop("r_")
