"""Spoken-language votes and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIXED = 0.15


def language_votes(votes: DataFrame, key: str = "call_id") -> DataFrame:
    """Mean probability of each language over all windows of a call (0 where a window lacks it), best first."""
    windows = votes.groupBy(key).agg(F.count_distinct("window").alias("n"))
    sums = votes.groupBy(key, "language").agg(F.sum("probability").alias("p"))
    rows = sums.join(windows, key).select(key, "language", F.round(F.col("p") / F.col("n"), 6).alias("probability"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("probability"), "language")))


def primary_language(votes: DataFrame, key: str = "call_id", limit: float = MIXED) -> DataFrame:
    """The first language of each call, its share, and whether the second has ``limit`` or more."""
    rows = language_votes(votes, key).where("rank <= 2")
    return rows.groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col("language"))).alias("primary_language"), F.max(F.when(F.col("rank") == 1, F.col("probability"))).alias("confidence"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("probability"))) >= limit, F.lit(False)).alias("is_mixed"),
    )


def word_shares(words: DataFrame, key: str = "call_id") -> DataFrame:
    """Each language's share of a transcript's words."""
    n = words.groupBy(key, "language").agg(F.count("*").alias("n"))
    return n.select(key, "language", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(key)), 6).alias("probability"))


def route(primary: Column, is_mixed: Column, ratio: Column) -> Column:
    """The Hebrew recogniser only for clearly Hebrew speech."""
    return F.when((primary == "he") & ~is_mixed & (ratio >= 0.90), "hebrew").otherwise("multilingual")


def sampled_regions(regions: DataFrame, key: str = "call_id", first: int = 4, longest: int = 15_000) -> DataFrame:
    """Up to ``first`` regions of a call, each cut to ``longest`` ms."""
    w = Window.partitionBy(key).orderBy("start_ms", "end_ms")
    rows = regions.withColumn("window", F.row_number().over(w)).where(F.col("window") <= first)
    return rows.select(key, "window", "start_ms", F.least("end_ms", F.col("start_ms") + longest).alias("end_ms"))
