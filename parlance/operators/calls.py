"""Operators on call tables: filters and pages, dashboards, sweeps, and writes as table rewrites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALIASES = {"he": ("he", "hebrew"), "ru": ("ru", "russian"), "en": ("en", "english")}
DAYS = {"today": 0, "7d": 7, "30d": 30}


@dataclass(frozen=True)
class CallFilter:
    """All given parts must hold; bounds of time are inclusive."""

    organization_id: int | None = None
    external_id: str | None = None
    status: str | None = None
    direction: str | None = None
    created_from: str | None = None
    created_to: str | None = None
    limit: int = 50
    offset: int = 0

    def predicate(self) -> Column:
        out = F.lit(True)
        for c, v in (("organization_id", self.organization_id), ("external_id", self.external_id), ("status", self.status), ("direction", self.direction)):
            if v is not None:
                out = out & (F.col(c) == v)
        if self.created_from:
            out = out & (F.col("created_at") >= F.lit(self.created_from).cast("timestamp_ntz"))
        if self.created_to:
            out = out & (F.col("created_at") <= F.lit(self.created_to).cast("timestamp_ntz"))
        return out


@dataclass(frozen=True)
class DisplayFilter:
    """The list page's filter. Unknown languages and dates filter nothing; ``text`` may hold LIKE's wildcards."""

    status: str | None = None
    language: str | None = None
    date: str | None = None
    text: str | None = None
    limit: int = 20
    offset: int = 0

    def predicate(self, now: str) -> Column:
        out = F.lit(True)
        if self.status in ("completed", "pending", "processing", "failed"):
            out = out & (F.col("status") == self.status)
        if self.language in ALIASES:
            out = out & F.col("primary_language").isin(*ALIASES[self.language])
        if self.date in DAYS:
            out = out & (F.col("created_at") >= F.date_sub(F.lit(now).cast("date"), DAYS[self.date]).cast("timestamp_ntz"))
        if self.text:
            out = out & F.col("external_id").like(f"%{self.text}%")
        return out


def page_of(page: int, size: int, total: int) -> tuple[int, int, int]:
    """(offset, size, pages) for a page number; size 10 to 100, one page at least."""
    size = min(100, max(10, size))
    return (max(1, page) - 1) * size, size, max(1, -(-total // size))


def newest_first() -> list[Column]:
    return [F.desc("is_favorite"), F.desc("created_at"), F.asc("id")]


def listed(calls: DataFrame, want: CallFilter) -> DataFrame:
    return calls.where(want.predicate()).orderBy(*newest_first()).offset(want.offset).limit(want.limit)


def for_display(calls: DataFrame, transcripts: DataFrame, want: DisplayFilter, now: str) -> DataFrame:
    """Calls with their transcripts' languages, filtered; page and total both start from this."""
    t = transcripts.select(F.col("call_id").alias("id"), "primary_language", "sample_text")
    return calls.join(t, "id", "left").where(want.predicate(now))


def display_page(calls: DataFrame, transcripts: DataFrame, want: DisplayFilter, now: str) -> DataFrame:
    return for_display(calls, transcripts, want, now).orderBy(*newest_first()).offset(want.offset).limit(want.limit)


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("status").alias("n"))


def call_stats(calls: DataFrame) -> DataFrame:
    """One row: all, completed, mean and sum of durations (0 if there are none)."""
    return calls.agg(
        F.count("*").alias("total"), F.coalesce(F.sum((F.col("status") == "completed").cast("bigint")), F.lit(0)).alias("completed"),
        F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 4).alias("avg_duration_ms"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("sum_duration_ms"),
    )


def top_intents(analyses: DataFrame, k: int) -> DataFrame:
    rows = analyses.where("customer_intent IS NOT NULL AND customer_intent <> ''").groupBy("customer_intent").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "customer_intent").limit(k)


def daily_counts(calls: DataFrame, days: int) -> DataFrame:
    """The last ``days`` days that have calls, newest first."""
    return calls.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(days)


def languages(transcripts: DataFrame) -> DataFrame:
    """Counts by the raw language; null has a label but is not the language of that name."""
    return transcripts.groupBy("primary_language").agg(F.count("*").alias("n")).select(F.coalesce("primary_language", F.lit("unknown")).alias("language"), "n")


def system_metrics(jobs: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: jobs by state beside the calls' statistics."""
    states = ("pending", "running", "completed", "failed")
    counts = jobs.agg(*[F.count_if(F.col("status") == s).alias(f"jobs_{s}") for s in states])
    return counts.withColumn("k", F.lit(1)).join(call_stats(calls).withColumn("k", F.lit(1)), "k").drop("k")


def dashboard(calls: DataFrame, analyses: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Names and values: hours, completion, the top intents' shares of one another, and languages' shares."""
    s = call_stats(calls)
    hours = s.select(F.lit("hours").alias("name"), F.round(F.col("sum_duration_ms") / 3_600_000, 4).alias("value"))
    done = s.select(F.lit("completion_pct").alias("name"), F.when(F.col("total") > 0, F.round(100.0 * F.col("completed") / F.col("total"), 4)).otherwise(0.0).alias("value"))
    top = top_intents(analyses, 5)
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # five rows
    intents = top.select(F.concat(F.lit("intent:"), "customer_intent").alias("name"), share.cast("double").alias("value"))
    n = transcripts.agg(F.count("*").alias("n"), F.count_if(F.col("primary_language").isin(*ALIASES["he"])).alias("he"), F.count_if(F.col("primary_language").isin(*ALIASES["ru"])).alias("ru"))
    pct = lambda c: F.when(F.col("n") > 0, F.round(100.0 * F.col(c) / F.col("n"))).otherwise(0.0)
    n = n.select(pct("he").alias("he"), pct("ru").alias("ru")).withColumn("en", 100 - F.col("he") - F.col("ru"))
    langs = n.select(F.explode(F.create_map(*[x for c in ("he", "ru", "en") for x in (F.lit(f"lang:{c}"), F.col(c).cast("double"))])).alias("name", "value"))
    return hours.unionByName(done).unionByName(intents).unionByName(langs)


def day_bars(daily: DataFrame) -> DataFrame:
    """Each day's bar height: a share of the largest, 8 at least."""
    return daily.select("day", "n", F.greatest(F.lit(8), F.floor(100 * F.col("n") / F.max("n").over(Window.partitionBy()))).cast("bigint").alias("height"))


def fresh_name(taken: list[str], name: str) -> str:
    """``name``, with a number if there is one already."""
    used, free, k = {t.lower() for t in taken}, name, 0
    while free.lower() in used:
        k += 1
        free = f"{name}_{k}"
    return free


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("r_ = 1").drop("r_")


def last_errors(jobs: DataFrame) -> DataFrame:
    """Each call's error, only if its newest job failed."""
    newest = latest(jobs.where("call_id IS NOT NULL"), "call_id", F.desc("created_at"), F.desc("id"))
    return newest.where("status = 'failed'").select("call_id", "id", "last_error")


def awaited(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs of a kind for whose call there is no result yet."""
    return jobs.where("call_id IS NOT NULL").select("call_id", "kind").distinct().join(results.select("call_id", "kind"), ["call_id", "kind"], "left_anti")


def orphans(calls: DataFrame, jobs: DataFrame) -> DataFrame:
    """Calls in processing whose id is NOT IN the live jobs' calls: none at all if a live job has no call, as SQL has it."""
    live = jobs.where("status IN ('pending', 'running')").select(F.col("call_id").alias("id"))
    # one look for a null, then a join by key: NOT IN itself would send all live jobs to every task
    rows = calls.where("status = 'processing' AND id IS NOT NULL")
    return rows.where(F.lit(False)) if not live.where("id IS NULL").isEmpty() else rows.join(live, "id", "left_anti")


def orphans_intended(calls: DataFrame, jobs: DataFrame) -> DataFrame:
    """The same without the surprise: live jobs without a call don't count."""
    live = jobs.where("status IN ('pending', 'running') AND call_id IS NOT NULL").select(F.col("call_id").alias("id"))
    return calls.where("status = 'processing'").join(live, "id", "left_anti")


def covered(calls: DataFrame, jobs: DataFrame) -> DataFrame:
    """Calls in processing that a live job covers go back to pending."""
    live = jobs.where("status IN ('pending', 'running')").select(F.col("call_id").alias("id"))
    return calls.where("status = 'processing'").join(live, "id", "left_semi").withColumn("status", F.lit("pending"))


def created(calls: DataFrame, new: DataFrame) -> DataFrame:
    """Of new calls those whose (organization_id, external_id) isn't there; a null external id never collides."""
    keys = ["organization_id", "external_id"]
    named = new.where("external_id IS NOT NULL").withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where("r_ = 1").drop("r_")
    named = named.join(calls.select(*keys), keys, "left_anti").select(*calls.columns)
    return named.unionByName(new.where("external_id IS NULL").select(*calls.columns))


def appended_new(calls: DataFrame, new: DataFrame) -> DataFrame:
    """``calls`` and, of new ones, what ``created`` lets in."""
    return calls.unionByName(created(calls, new))


def updated(rows: DataFrame, key: str, value: object, **changes: Column) -> DataFrame:
    """``rows`` with some columns changed where ``key`` is ``value``."""
    return rows.withColumns({c: F.when(F.col(key) == value, v).otherwise(F.col(c)) for c, v in changes.items()})


def without(rows: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """``rows`` of which ``key`` is not among ``gone``: one step of a cascading delete."""
    return rows.join(gone.select(F.col(gone_key).alias(key)), key, "left_anti").select(*rows.columns)


def upserted(old: DataFrame, new: DataFrame, *key: str, newest: str | None = None) -> DataFrame:
    """One row of ``new`` for each key, and of ``old`` what ``new`` doesn't replace.

    Of several new rows for a key the one with the greatest ``newest`` counts;
    of equal ones, or without it, that with the greatest values.
    """
    rest = [c for c in new.columns if c not in key]
    if rest:
        order = [newest, *[c for c in rest if c != newest]] if newest else rest
        sortable = [F.to_json(c) if dict(new.dtypes)[c].startswith("map") else F.col(c) for c in order]
        new = new.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*sortable)).alias("v_")).select(*key, "v_.*").select(*new.columns)
    else:
        new = new.distinct()
    return old.join(new.select(*key), list(key), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def voice_prints_merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """New embeddings by (call_id, speaker_id); a given name stays."""
    o = old.select("call_id", "speaker_id", F.col("embedding").alias("e0"), "name")
    n = new.select("call_id", "speaker_id", F.col("embedding").alias("e1"))
    return o.join(n, ["call_id", "speaker_id"], "full").select("call_id", "speaker_id", F.coalesce("e1", "e0").alias("embedding"), "name")


def reprocessing(calls: DataFrame, kind: str = "analyze") -> DataFrame:
    """A pending job for each completed call."""
    return calls.where("status = 'completed'").select(F.col("id").alias("call_id"), F.lit(kind).alias("kind"), F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("attempt"))


def named_speakers(voice_prints: DataFrame, calls: DataFrame, organization_id: int) -> DataFrame:
    """Named voice prints of one organisation's calls only."""
    mine = calls.where(F.col("organization_id") == organization_id).select(F.col("id").alias("call_id"))
    return voice_prints.where("name IS NOT NULL").join(mine, "call_id")
