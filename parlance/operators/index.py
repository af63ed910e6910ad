"""A kept text index: postings and lengths as tables, with replacing, retitling and deleting of entries.

A search reads postings by ranges of terms (they are sorted by term in blocks of
some thousand entries, so a prefix is a scan of few pages) and never the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.search import K1, B, _prefixes, n_words, postings

#: The columns of an entry that are searched.
COLUMNS = ("title", "summary", "transcript", "topics", "entities", "reason", "resolution")
#: Changed entries' ids that are sent to all tasks; more are joined by call.
MOST_IDS = 1_000_000


def entries(rows: DataFrame) -> DataFrame:
    """Index entries: lists (topics, entities) joined by blanks, missing texts empty."""
    text = lambda c: F.coalesce(F.array_join(c, " ") if dict(rows.dtypes)[c].startswith("array") else F.col(c), F.lit("")).alias(c)
    return rows.select("call_id", "organization_id", *[text(c) for c in COLUMNS])


@dataclass(frozen=True)
class Index:
    """``postings`` (call_id, column, term, tf) and ``lengths`` (call_id, organization_id, column, n)."""

    postings: DataFrame
    lengths: DataFrame

    def without(self, calls: DataFrame) -> Index:
        """The index without some calls' entries; those that aren't there don't matter."""
        gone = calls.select("call_id").distinct()
        return Index(self.postings.join(gone, "call_id", "left_anti"), self.lengths.join(gone, "call_id", "left_anti"))

    def replaced(self, new: DataFrame) -> Index:
        """New entries in place of those that their calls had."""
        kept, more = self.without(new), built(new)
        return Index(kept.postings.unionByName(more.postings), kept.lengths.unionByName(more.lengths))

    def retitled(self, titles: DataFrame) -> Index:
        """New titles (call_id, title) for entries that are there; nothing else is indexed again."""
        known = titles.join(self.lengths.select("call_id", "organization_id").distinct(), "call_id")
        more, title = _built(known, ("title",)), F.col("column") == "title"
        ids = known.select("call_id")
        if titles.count() > MOST_IDS:
            old = lambda rows: rows.where(~title).unionByName(rows.where(title).join(ids, "call_id", "left_anti"))
        else:  # one look at the rows, which may have to be counted first
            new = F.broadcast(ids.select(F.col("call_id").alias("id_")))
            old = lambda rows: rows.join(new, (F.col("call_id") == F.col("id_")) & title, "left_anti")
        return Index(old(self.postings).unionByName(more.postings), old(self.lengths).unionByName(more.lengths))

    def saved(self, folder: str) -> Index:
        """The index as tables in ``folder``, postings as they come: a block's in the order of terms."""
        self.postings.write.parquet(f"{folder}/postings")
        self.lengths.write.parquet(f"{folder}/lengths")
        return opened(self.postings.sparkSession, folder)

    def matches(self, query: str) -> DataFrame:
        """``call_id`` of the entries with a word that begins with one of the query's terms, once each; none for a blank query."""
        return self.postings.where(_any(_prefixes(query))).select("call_id").distinct()

    def ranked(self, query: str) -> DataFrame:
        """``score`` (BM25, larger is better) of each matching entry, from the postings of its terms alone."""
        prefixes = _prefixes(query)
        hits = self.postings.where(_any(prefixes))
        counts = hits.groupBy("call_id").agg(*[F.sum(F.when(_begins(p), F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, p in enumerate(prefixes)] or [F.lit(0).alias("tf")])
        lengths = self.lengths.groupBy("call_id").agg(F.sum("n").alias("dl"))
        totals = self.lengths.agg(F.count_distinct("call_id").alias("n"), F.sum("n").alias("words"))
        stats = counts.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(prefixes))] or [F.lit(0).alias("df")])
        one = lambda df: F.broadcast(df.withColumn("k_", F.lit(1)))  # noqa: E731  one row
        rows = counts.join(lengths, "call_id").withColumn("k_", F.lit(1)).join(one(totals), "k_").join(one(stats), "k_")
        score = F.lit(0.0)
        for i in range(len(prefixes)):
            tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
            idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / (F.col("words") / F.col("n"))))
        return rows.select("call_id", score.alias("score"))


def _begins(prefix: str) -> Column:
    """A range of terms, which the scan can prune."""
    return (F.col("term") >= prefix) & (F.col("term") < prefix + "\U0010ffff")


def _any(prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | _begins(p)
    return out


def _built(rows: DataFrame, columns: tuple[str, ...]) -> Index:
    # words are counted last, so that what asks for ids alone reads no texts
    flat = rows.select("call_id", "organization_id", *columns, F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    n = F.coalesce(*[F.when(F.col("column") == c, n_words(F.coalesce(F.col(c), F.lit("")))) for c in columns])
    lengths = flat.select("call_id", "organization_id", "column", n.cast("bigint").alias("n"))
    return Index(postings(rows, columns).drop("first_pos"), lengths)


def built(rows: DataFrame) -> Index:
    """The index of ``entries``."""
    return _built(rows, COLUMNS)


def opened(spark: SparkSession, folder: str) -> Index:
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths"))


def listed(calls: DataFrame, index: Index, text: str) -> DataFrame:
    """Calls whose external id holds ``text`` (LIKE, unescaped) or whose entry matches it: a list page's search box."""
    text = text.strip()
    if not text:
        return calls
    hits = index.matches(text).select(F.col("call_id").alias("id"), F.lit(True).alias("hit_"))
    return calls.join(hits, "id", "left").where(F.col("external_id").like(f"%{text}%") | F.col("hit_")).select(*calls.columns)


def searched(index: Index, calls: DataFrame, query: str, organization_id: int | None = None, created_from: str | None = None, created_to: str | None = None, direction: str | None = None, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """The best entries whose calls meet all given conditions, with their score; none for a blank query."""
    rows = calls
    for c, v in (("organization_id", organization_id), ("direction", direction), ("status", status)):
        rows = rows if v is None else rows.where(F.col(c) == v)
    rows = rows if created_from is None else rows.where(F.col("created_at") >= F.lit(created_from).cast("timestamp_ntz"))
    rows = rows if created_to is None else rows.where(F.col("created_at") <= F.lit(created_to).cast("timestamp_ntz"))
    hits = index.ranked(query).withColumn("score", F.round("score", 6)).join(rows.withColumnRenamed("id", "call_id"), "call_id")
    return hits.orderBy(F.desc("score"), F.desc("created_at"), "call_id").offset(offset).limit(limit)
