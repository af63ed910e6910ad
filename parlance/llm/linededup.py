"""Line dedup: lines that several documents share stay in the first of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, fresh, salted_groups, written


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """The lines to drop: id, the text's hash ``th`` and the sorted positions ``drop``.

    Keys are 128-bit digests. Counting runs over (key, salt), where the salt is
    the document's, so a line that a third of all documents hold is counted and
    joined by many tasks; the few rows left for each key are then summed up.
    """
    lines = (
        docs.select(
            F.col(id_col).alias("doc"),
            F.xxhash64(F.col(text_col)).alias("th"),
            F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("pos", "line"),
        )
        .select("doc", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc", "th", "pos", F.unhex(F.md5("key")).alias("kh"))
    )
    lines = written(salted_groups(lines, ["kh"], "doc"), "lines")
    parts = lines.groupBy("kh", "salt", "doc").agg(F.lit(1).alias("one")).groupBy("kh", "salt").agg(F.count("doc").alias("docs"), F.min("doc").alias("least"))
    keys = parts.groupBy("kh").agg(F.sum("docs").alias("docs"), F.min("least").alias("first"), F.collect_set("salt").alias("salts")).where(F.col("docs") >= min_docs)
    shared = keys.select("kh", "first", F.explode("salts").alias("salt"))
    return (
        lines.join(shared, ["kh", "salt"])
        .where(F.col("doc").isNull() | (F.col("doc") > F.col("first")))
        .groupBy("doc", "th")
        .agg(F.array_sort(F.collect_set("pos")).alias("drop"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with the shared lines dropped from the text, and two counts added.

    A line's key is ``line_key``. Keys of at least ``min_chars`` code points in
    at least ``min_docs`` documents lose all their lines except in the smallest
    id that holds them; lines that repeat within one document only stay. A null
    or empty text is one empty line (and becomes the empty text). Rows that
    repeat an id are one document. A null id counts as no document, so it makes
    no line shared, but loses the lines that others share. A very long text is
    split whole, in memory in proportion to its length. Other columns,
    whatever their names, pass through; an empty table gives an empty table.
    """
    n_lines, n_dropped, th, of, drop, doc, lines = fresh(docs.columns, n_lines, n_dropped, "th", "of", "drop", "doc", "lines")
    found = shared_lines(docs, id_col, text_col, min_chars, min_docs).select(F.col("doc").alias(doc), F.col("th").alias(of), F.col("drop").alias(drop))
    all_lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    # the runs of kept lines between one dropped position and the next
    edges = F.concat(F.array(F.lit(-1)), F.col(drop), F.array(F.size(lines)))
    runs = F.transform(F.arrays_zip(F.slice(edges, 1, F.size(drop) + 1).alias("a"), F.slice(edges, 2, F.size(drop) + 1).alias("b")), lambda e: F.slice(F.col(lines), e["a"] + 2, e["b"] - e["a"] - 1))
    kept = F.when(F.col(drop).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.flatten(runs), "\n"))
    joined = docs.withColumn(th, F.xxhash64(F.col(text_col))).join(found, F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(th) == F.col(of)), "left")
    return joined.withColumn(lines, all_lines).select(
        *[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.size(lines).cast("bigint").alias(n_lines),
        F.coalesce(F.size(drop), F.lit(0)).cast("bigint").alias(n_dropped),
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The digest of ``dedup_lines`` over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (WHERE s.k IS NOT NULL AND doc_id > first_doc)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.k IS NULL OR doc_id = first_doc), '')) AS kept_sha256
FROM keyed LEFT JOIN shared s ON keyed.k = s.k
GROUP BY doc_id
"""
