"""A text index of small immutable segments: an update writes its own rows, a search reads ranges of terms.

A segment has its entries sorted by call, postings (with the words' positions and
the entry's length) sorted by term in blocks of some thousand entries, and marks
for what it replaces in older segments.
A manifest names the segments and the totals that ranking needs; it is
published by a rename, so readers see an update whole or not at all, and of two
writers one has to try again. Merging rewrites the newest segments as one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.operators.calls import DisplayFilter, newest_first
from parlance.operators.index import COLUMNS, _any, _begins
from parlance.operators.search import K1, WORD, B, _prefixes, folded, n_words, occurrences, repeats
from parlance.sources import publish

POSTINGS = "call_id bigint, column string, term string, positions array<int>, dl bigint"
ENTRIES = "call_id bigint, organization_id bigint, title string, summary string, transcript string, title_n bigint, dl bigint, part string"
GONE = "call_id bigint, part string"
#: Marks of replaced entries that are sent to all tasks; more are joined by call.
MOST_MARKS = 1_000_000
#: The weight of a position, the limit of the sum of 1 / i ** 2, and the most positions of a word.
WEIGHT, LIMIT, MOST_POSITIONS = 0.1, 1.64493406685, 256


class Conflict(RuntimeError):
    """Another writer has published in the meantime."""


@dataclass(frozen=True)
class Segmented:
    """The index in ``folder``."""

    spark: SparkSession
    folder: str

    # what there is

    def manifest(self) -> dict:
        found = publish.names(self.spark, f"{self.folder}/manifest")
        return json.loads(publish.read(self.spark, f"{self.folder}/manifest/{found[-1]}")) if found else {"version": 0, "next": 1, "segments": [], "entries": 0, "words": 0}

    def _table(self, kind: str, schema: str, segments: list[dict]) -> DataFrame:
        held = [f"{self.folder}/{kind}/seg={s['seg']}" for s in segments if s[kind]]
        if not held:
            return self.spark.createDataFrame([], f"{schema}, seg int")
        return self.spark.read.schema(f"{schema}, seg int").option("basePath", f"{self.folder}/{kind}").parquet(*held)

    def _alive(self, rows: DataFrame, segments: list[dict], titles: Column) -> DataFrame:
        """Those of ``rows`` that no later segment replaces, in one look at them; ``titles``: which of them a new title replaces too."""
        if not any(s["gone"] for s in segments):
            return rows
        entry = F.when(F.col("part") == "entry", F.col("seg"))
        last = self._table("gone", GONE, segments).groupBy("call_id").agg(F.max("seg").alias("any_"), F.max(entry).alias("last_"))
        last = F.broadcast(last) if sum(s["gone"] for s in segments) <= MOST_MARKS else last
        limit = F.when(titles, F.col("any_")).otherwise(F.col("last_"))
        return rows.join(last, "call_id", "left").where(F.col("seg") >= F.coalesce(limit, F.lit(0))).drop("any_", "last_")

    def entries(self, segments: list[dict] | None = None) -> DataFrame:
        """The entries as they are now; a new title stands in an entry of its own kind, without the other texts."""
        held = self.manifest()["segments"] if segments is None else segments
        return self._alive(self._table("entries", ENTRIES, held), held, F.lit(True))

    def postings(self, segments: list[dict] | None = None, terms: Column | None = None) -> DataFrame:
        held = self.manifest()["segments"] if segments is None else segments
        rows = self._table("postings", POSTINGS, held)
        rows = rows if terms is None else rows.where(terms)
        return self._alive(rows, held, F.col("column") == "title")

    # changes

    def _publish(self, known: dict, segments: list[dict], entries: int, words: int) -> None:
        now = {"version": known["version"] + 1, "next": known["next"] + 1, "segments": segments, "entries": entries, "words": words}
        if not publish.publish(self.spark, f"{self.folder}/manifest", f"v{now['version']:09d}.json", json.dumps(now)):
            raise Conflict(f"version {now['version']} is there already")

    def _written(self, seg: int, kind: str, rows: DataFrame) -> int:
        path = f"{self.folder}/{kind}/seg={seg}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).count()

    def _added(self, rows: DataFrame, gone: DataFrame, part: str, columns: tuple[str, ...]) -> dict:
        """Writes a segment and publishes it; what it writes is in proportion to ``rows`` and ``gone``."""
        known = self.manifest()
        seg, old = known["next"], self.entries(known["segments"])
        # postings are made of the entries as they have been written: in even parts, texts read once more and not shuffled again
        held = self._written(seg, "entries", rows.withColumn("part", F.lit(part)))
        stored = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/entries/seg={seg}")
        new = {"seg": seg, "postings": self._written(seg, "postings", positions(stored, columns)), "entries": held}
        new["gone"] = self._written(seg, "gone", gone.select("call_id", F.lit(part).alias("part")).distinct()) if known["segments"] else 0
        marks, added = self._table("gone", GONE, [new]).select("call_id"), self._table("entries", ENTRIES, [new])
        less = old.join(marks.distinct(), "call_id", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        more = added.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        self._publish(known, [*known["segments"], new], known["entries"] + more.n - less.n, known["words"] + more.dl - less.dl)
        return new

    def replaced(self, rows: DataFrame) -> dict:
        """Entries (call_id, organization_id and COLUMNS) in place of those that their calls had; of repeated ids the greatest counts."""
        one = rows if not repeats(rows, "call_id") else rows.groupBy("call_id").agg(F.max(F.struct(*[c for c in rows.columns if c != "call_id"])).alias("r_")).select("call_id", "r_.*")
        sizes = [n_words(F.col(c)).cast("bigint") for c in COLUMNS]
        one = _by_call(one).withColumn("n_", F.array(*sizes)).withColumns({"title_n": F.get("n_", F.lit(0)), "dl": F.aggregate("n_", F.lit(0).cast("bigint"), lambda a, x: a + x)}).drop("n_")
        return self._added(one, rows, "entry", COLUMNS)

    def retitled(self, titles: DataFrame) -> dict:
        """New titles (call_id, title) for entries that are there: only these are indexed anew."""
        new = titles.groupBy("call_id").agg(F.max("title").alias("new_"))
        own = self.entries().join(new, "call_id").withColumn("n_", n_words(F.col("new_")).cast("bigint"))
        rows = own.withColumns({"title": F.col("new_"), "dl": F.col("dl") - F.col("title_n") + F.col("n_"), "title_n": F.col("n_"), "summary": F.lit(None).cast("string"), "transcript": F.lit(None).cast("string")}).drop("new_", "n_", "seg", "part")
        return self._added(rows, rows, "title", ("title",))

    def without(self, calls: DataFrame) -> dict:
        """Deletes entries; those that aren't there don't matter."""
        return self._added(self.spark.createDataFrame([], ENTRIES).drop("part"), calls, "entry", ())

    def merged(self, most: int = 8, growth: int = 2) -> dict | None:
        """If there are more than ``most`` segments, the newest ones become one; None if there is nothing to do.

        The oldest that takes part is at most ``growth`` times as large as all newer ones.
        """
        known = self.manifest()
        held = known["segments"]
        size = [s["postings"] + s["entries"] + s["gone"] for s in held]
        start = next((k for k in range(len(held) - 1) if size[k] <= growth * sum(size[k + 1 :])), None)
        if len(held) <= most or start is None:
            return None
        tail = held[start:]
        rest, seg = held[: len(held) - len(tail)], known["next"]
        # an entry whose title alone was changed here keeps its own texts; one of an older segment stays a change of title
        both = self._table("entries", ENTRIES, tail)
        whole = self._alive(both.where("part = 'entry'"), tail, F.lit(False)).drop("seg", "part")
        title = self._alive(both.where("part = 'title'"), tail, F.lit(True)).select("call_id", F.col("organization_id").alias("o_"), F.col("title").alias("t_"), F.col("title_n").alias("n_"), F.col("dl").alias("d_"))
        joined = whole.join(title, ["call_id"], "full").select("call_id", F.coalesce("organization_id", "o_").alias("organization_id"), F.when(F.col("n_").isNotNull(), F.col("t_")).otherwise(F.col("title")).alias("title"), "summary", "transcript", F.coalesce("n_", "title_n").alias("title_n"), F.coalesce("d_", "dl").alias("dl"), F.when(F.col("dl").isNull(), "title").otherwise("entry").alias("part"))
        # words' rows have their entry's length, which a new title changes
        # few titles are sent to the words, which are many
        sizes = title.select("call_id", "d_")
        sizes = F.broadcast(sizes) if both.where("part = 'title'").count() <= MOST_MARKS else sizes
        words = self.postings(tail).join(sizes, "call_id", "left").withColumn("dl", F.coalesce("d_", "dl")).drop("d_", "seg")
        new = {"seg": seg, "postings": self._written(seg, "postings", words.sortWithinPartitions("term", "call_id")), "entries": self._written(seg, "entries", _by_call(joined))}
        new["gone"] = self._written(seg, "gone", self._table("gone", GONE, tail).groupBy("call_id").agg(F.min("part").alias("part"))) if rest else 0
        self._publish(known, [*rest, new], known["entries"], known["words"])
        return new

    # searches

    def hits(self, query: str) -> DataFrame:
        """(call_id, column, term, positions, dl, and for each prefix whether the term begins with it); from ranges of terms alone."""
        prefixes = _prefixes(query)
        held = self.manifest()["segments"]
        rows = self.postings(held, _any(prefixes))
        if any(s["entries"] and s["gone"] for s in held):
            newer = self.entries(held).where("part = 'title'").select("call_id", F.col("dl").alias("dl_"))
            newer = F.broadcast(newer) if sum(s["gone"] for s in held) <= MOST_MARKS else newer  # titles have marks
            rows = rows.join(newer, "call_id", "left").withColumn("dl", F.coalesce("dl_", "dl")).drop("dl_")
        return rows.select("call_id", "column", "term", "positions", "dl", F.array(*[_begins(p) for p in prefixes] or [F.lit(False)]).alias("of"))

    def matches(self, query: str) -> DataFrame:
        return self.hits(query).select("call_id").distinct()

    def ranked(self, query: str) -> DataFrame:
        """``score`` (BM25, larger is better); entries and words in all come from the manifest."""
        known, prefixes = self.manifest(), _prefixes(query)
        counts = self.hits(query).groupBy("call_id").agg(F.max("dl").alias("dl"), *[F.sum(F.when(F.get("of", F.lit(i)), F.size("positions")).otherwise(0)).alias(f"tf{i}") for i in range(len(prefixes))])
        stats = counts.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(prefixes))] or [F.lit(0).alias("df")])
        rows = counts.withColumn("k_", F.lit(1)).join(F.broadcast(stats.withColumn("k_", F.lit(1))), "k_")  # one row
        score = F.lit(0.0)
        for i in range(len(prefixes)):
            tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
            idf = F.log(1 + (known["entries"] - df + 0.5) / (df + 0.5))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / (known["words"] / max(known["entries"], 1))))
        return rows.select("call_id", score.alias("score"))

    def rank_by_frequency(self, query: str) -> DataFrame:
        """``score`` as a document vector's rank for any of the prefixes: each word's positions count 1, 1/4, 1/9 and so on."""
        n = len(_prefixes(query))
        words = self.hits(query).groupBy("call_id", "term").agg(F.sum(F.size("positions")).alias("tf"), F.first("of").alias("of"))
        sums = F.aggregate(F.sequence(F.lit(1), F.least(F.col("tf"), F.lit(MOST_POSITIONS)).cast("int")), F.lit(0.0), lambda a, j: a + 1 / (j * j))
        times = F.aggregate("of", F.lit(0), lambda a, x: a + x.cast("int"))
        return words.groupBy("call_id").agg((F.sum(WEIGHT * sums * times / LIMIT) / max(n, 1)).alias("score"))

    def covers(self, query: str) -> DataFrame:
        """The shortest stretches of a column that have a word for every prefix: (call_id, column, first, last, hits).

        Each end has the latest start from which all prefixes are met; of ends
        with one start the first is taken.
        """
        n = len(_prefixes(query))
        at = self.hits(query).select("call_id", "column", F.explode("positions").alias("pos"), "of").groupBy("call_id", "column", "pos").agg(*[F.max(F.get("of", F.lit(i))).alias(f"p{i}") for i in range(n)])
        so_far = Window.partitionBy("call_id", "column").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        lasts = [F.max(F.when(F.col(f"p{i}"), F.col("pos"))).over(so_far) for i in range(n)]
        whole = F.lit(True)
        for i in range(n):
            whole = whole & F.col(f"l{i}").isNotNull()
        rows = at.withColumn("k", F.count("*").over(so_far)).withColumns({f"l{i}": c for i, c in enumerate(lasts)}).where(whole if n else F.lit(False))
        first = F.least(*[F.col(f"l{i}") for i in range(n)]) if n > 1 else F.col("l0") if n else F.lit(0)
        ends = rows.withColumn("first", first).groupBy("call_id", "column", "first").agg(F.min("pos").alias("last"), F.min("k").alias("k"))
        starts = at.withColumn("k0", F.count("*").over(so_far)).select("call_id", "column", F.col("pos").alias("first"), "k0")
        return ends.join(starts, ["call_id", "column", "first"]).select("call_id", "column", "first", "last", (F.col("k") - F.col("k0") + 1).alias("hits"))

    def rank_by_covers(self, query: str) -> DataFrame:
        """``score``: the sum over all ``covers`` of the weight over 1 and the words that are no hits; entries without a cover have none."""
        noise = F.col("last") - F.col("first") + 1 - F.col("hits")
        return self.covers(query).groupBy("call_id").agg(F.sum(WEIGHT / (1 + noise)).alias("score"))

    def page(self, calls: DataFrame, query: str, predicate: Column | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        """The best entries of calls that meet ``predicate``: call_id, title, summary, score, created_at and snippet.

        Texts are read of the page's entries only: by id, from tables sorted by it.
        """
        rows = calls if predicate is None else calls.where(predicate)
        found = self.ranked(query).withColumn("score", F.round("score", 6)).join(rows.select(F.col("id").alias("call_id"), "created_at"), "call_id")
        top = found.orderBy(F.desc("score"), F.desc("created_at"), "call_id").offset(offset).limit(limit).collect()  # a page
        held = self.manifest()["segments"]
        ids = [r.call_id for r in top]
        # equalities prune pages one by one, a list of more than ten ids only the range of all
        entries = self._table("entries", ENTRIES, held).where(reduce(Column.__or__, [F.col("call_id") == i for i in ids], F.lit(False)))
        whole = self._alive(entries.where("part = 'entry'"), held, F.lit(False))
        newer = self._alive(entries.where("part = 'title'"), held, F.lit(True)).select("call_id", F.col("title").alias("t_"))
        texts = whole.join(newer, "call_id", "left").select("call_id", F.coalesce("t_", "title").alias("title"), "summary", "transcript")
        page = self.spark.createDataFrame([tuple(r) for r in top], found.select("call_id", "score", "created_at").schema)
        marked = snippets(texts.select("call_id", F.col("transcript").alias("text")), query)
        return page.join(texts.drop("transcript"), "call_id").join(marked, "call_id", "left").select("call_id", "title", "summary", "score", "created_at", F.coalesce("snippet", F.lit("")).alias("snippet"))

    def display(self, calls: DataFrame, transcripts: DataFrame, want: DisplayFilter, now: str) -> tuple[DataFrame, DataFrame]:
        """A list page and its total (one row), by the same predicate: text is looked for in external ids or in the index."""
        text = (want.text or "").strip()
        rows = calls.join(transcripts.withColumnRenamed("call_id", "id"), "id", "left")
        rows = rows.where(DisplayFilter(want.status, want.language, want.date).predicate(now))
        if text:
            hits = self.matches(text).select(F.col("call_id").alias("id"), F.lit(True).alias("hit_"))
            rows = rows.join(hits, "id", "left").where(F.col("external_id").like(f"%{text}%") | F.coalesce("hit_", F.lit(False))).drop("hit_")
        return rows.orderBy(*newest_first()).offset(want.offset).limit(want.limit), rows.agg(F.count("*").alias("total"))


def _by_call(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("call_id").sortWithinPartitions("call_id")


def positions(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(call_id, column, term, positions, dl) of all words of some columns."""
    if not columns:
        return rows.sparkSession.createDataFrame([], POSTINGS)
    return occurrences(rows, ("call_id", "dl"), columns).select("call_id", "column", "term", "positions", "dl")


def snippets(rows: DataFrame, query: str, size: int = 15, before: str = "<b>", after: str = "</b>") -> DataFrame:
    """(call_id, snippet, n_hits) of texts (call_id, text): the first of the stretches of ``size`` words with most hits, hits marked.

    A stretch begins with a hit, earlier where the text ends before it is full;
    what is left out at an end becomes an ellipsis. Texts without a hit have none.
    """
    hit = lambda w: _any_of(F.regexp_extract(folded(w), WORD, 0), query)
    rows = rows.withColumn("ws", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    at = rows.select("call_id", F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "w")).where(hit(F.col("w")))
    within = Window.partitionBy("call_id").orderBy("pos").rangeBetween(0, size - 1)
    best = at.withColumn("k", F.count("*").over(within)).groupBy("call_id").agg(F.max_by(F.struct("pos", "k", "n"), F.struct("k", -F.col("pos"))).alias("b"))
    start = F.greatest(F.least(F.col("b.pos"), F.col("b.n") - size), F.lit(0))
    cut = F.transform(F.slice("ws", F.col("start") + 1, size), lambda w: F.when(hit(w), F.concat(F.lit(before), w, F.lit(after))).otherwise(w))
    text = F.concat(F.when(F.col("start") > 0, "...").otherwise(""), F.array_join(cut, " "), F.when(F.col("start") + size < F.size("ws"), "...").otherwise(""))
    return rows.join(best, "call_id").withColumn("start", start).select("call_id", text.alias("snippet"), F.col("b.k").alias("n_hits"))


def _any_of(word: Column, query: str) -> Column:
    out = F.lit(False)
    for p in _prefixes(query):
        out = out | word.startswith(p)
    return out


# What is answered where no model answers, and how a source is told.
NOTHING = "No relevant conversations found matching the query in the call archives."
FOUND = "Found %d relevant call(s) regarding your query. Please review the cited calls below."
SOURCE = "Source [%d]: Call ID: %s\nTitle: %s\nSummary: %s\nExcerpt: %s\n\n"


def asked(index: Segmented, calls: DataFrame, question: str, most: int = 5) -> DataFrame:
    """One row for a question: the sources' text for a model, the answer where there is none, and the calls cited (with their summaries and 0.90)."""
    page = index.page(calls, question, limit=most)
    numbered = page.withColumn("source", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), F.desc("created_at"), "call_id")))  # a page
    told = F.format_string(SOURCE, "source", F.col("call_id").cast("string"), "title", "summary", "snippet")
    cited = F.struct("source", "call_id", F.col("summary").alias("text_snippet"), F.lit(0.9).alias("relevance_score"))
    rows = numbered.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("source", told.alias("text")))).alias("t"), F.array_sort(F.collect_list(cited)).alias("citations"))
    return rows.select(F.array_join(F.transform("t", lambda x: x["text"]), "").alias("context"), F.when(F.col("n") == 0, NOTHING).otherwise(F.format_string(FOUND, "n")).alias("answer"), "citations")
