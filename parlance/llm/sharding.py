"""Sharding: proportional stratified interleaving of sources."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

#: Rows that one window group may hold on average before groups are made finer.
GROUP_ROWS = 65_536


def hex_digits(rows: int) -> int:
    """Hex digits of a hash that cut ``rows`` rows into groups of about GROUP_ROWS: 2 to 5."""
    return min(5, max(2, math.ceil(math.log(max(rows, 1) / GROUP_ROWS, 16)))) if rows > GROUP_ROWS else 2


def seeded_key(seed: str, *cols: Column) -> Column:
    """The place of a row in a seeded shuffle: 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]))


def running(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column | None = None) -> DataFrame:
    """``before``: how many rows (or how much of ``value``) come before a row within ``group``.

    The order is by ``bucket``, then ``order``. No task sorts a whole group:
    rows are numbered within (group, bucket), and the buckets' totals, one row
    for each bucket, are summed up apart from the rows.
    """
    total = F.count("*") if value is None else F.sum(value)
    w = Window.partitionBy(*group, bucket).orderBy(*order)
    inner = df.withColumn("in_bucket", (F.row_number().over(w) - 1).cast("bigint") if value is None else F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - value)
    sums = df.groupBy(*group, bucket).agg(total.alias("held"))
    across = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, bucket, F.coalesce(F.sum("held").over(across), F.lit(0)).alias("ahead"))
    return inner.join(sums, [*group, bucket]).withColumn("before", F.col("ahead") + F.col("in_bucket")).drop("ahead", "in_bucket")


def interleaved(docs: DataFrame, shards: int = 8, seed: str = "shards-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard: str = "shard", slot: str = "slot") -> DataFrame:
    """id, source and text digest of every row with its shard and its slot in the shard.

    Rows of a source are ranked in a seeded shuffle; rank r of n stands at
    (r + u) / n, u being the source's own seeded fraction; all rows are sorted by that fraction and cut into runs
    whose lengths differ by one at most, so each shard holds every source in
    the corpus's own proportion to within a row or two. Ties at a fraction go
    by source, then by the shuffle. Null sources are a source of their own; a
    null id or text takes part like any other value; repeated rows each get a
    slot, in an order that ids and texts decide. Very long texts are only
    measured and summed. Fewer rows than shards leave shards empty; an empty
    table gives none. Columns but these three play no part.

    No task sorts more than a group's cell: about GROUP_ROWS rows on average.
    """
    src, key, size, crc = "source_key", "key", "size", "text_crc32"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias(src),
        (F.octet_length(text).cast("bigint") + 1).alias(size),
        F.crc32(text.cast("binary")).alias(crc),
        seeded_key(seed, F.col(id_col)).alias(key),
    )
    rows = written(rows, "rows")  # the texts are read once
    n = rows.count()
    digits = hex_digits(n)
    first = F.conv(F.substring(key, 1, digits), 16, 10).cast("int")
    ranked = running(rows.withColumn("bucket", first), [src], "bucket", [F.col(key), F.col("id"), F.col(crc), F.col(size)]).drop("bucket")
    of = rows.groupBy(src).agg(F.count("*").alias("n"))  # a row for each source
    cells = 16**digits
    # where in its first step a source begins: else sources of one size would come in clumps
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(src))), 1, 8), 16, 10).cast("double") / 2**32
    placed = ranked.join(of, src).select(
        "id", src, size, crc, key,
        ((F.col("before") + start) / F.col("n")).alias("at"),
    ).withColumn("cell", F.least(F.floor(F.col("at") * cells), F.lit(cells - 1)).cast("int"))
    placed = running(placed, [], "cell", [F.col("at"), F.col(src), F.col(key), F.col("id"), F.col(crc), F.col(size)])
    at = F.col("before")
    number = F.call_function("div", at * shards, F.lit(max(n, 1)).cast("bigint"))
    begin = F.call_function("div", number * F.lit(n).cast("bigint") + (shards - 1), F.lit(shards).cast("bigint"))
    return placed.select("id", src, size, crc, number.cast("int").alias(shard), (at - begin).cast("bigint").alias(slot))


def op10_stratified_shards(spark, sf_dir: str) -> DataFrame:
    """``interleaved`` over all documents into shards 0 to 7; the law is that counts are at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return interleaved(docs).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        F.when(F.col("source_key") != "", F.substring("source_key", 2, 1 << 30)).alias("source"),
    )


def _nibble(c: str) -> str:
    return f"xor({c} >> 4, crc[({c} & 15) + 1])"


#: The query in SQL. A CRC-32 goes over the text's bytes in half bytes, with a table made by its rule.
OP10_SQL = rf"""
WITH t AS (SELECT list(c ORDER BY i) AS crc FROM (
  SELECT i, list_reduce(list_concat([i], range(4)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(16) r(i))),
d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS src, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, md5('shards-1:' || coalesce(doc_id::VARCHAR, 'null')) AS key,
    list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT)) AS bytes
  FROM documents),
c AS (SELECT doc_id, source, src, size, key, xor(list_reduce(bytes, lambda c, b: {_nibble(_nibble("xor(c, b)"))}), 4294967295) AS text_crc32 FROM d, t),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY key, doc_id, text_crc32, size) - 1 AS before, count(*) OVER (PARTITION BY src) AS held, count(*) OVER () AS n FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (before + ('0x' || substr(md5('shards-1:' || src), 1, 8))::BIGINT / 4294967296) / held, src, key, doc_id, text_crc32, size) - 1 AS place FROM r),
s AS (SELECT *, place * 8 // n AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, place - (shard * n + 7) // 8 AS slot, NULL::INTEGER AS grown_shard, source FROM s
"""
