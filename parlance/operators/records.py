"""Single records and the writes that users make, as functions from one table to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.calls import latest, updated, upserted


class NotFound(LookupError):
    """A write that names a row which isn't there."""


def found(rows: DataFrame, key: str, value: object) -> DataFrame:
    """``rows``, or an error where none has ``value``: a point lookup, pushed down to the scan."""
    if rows.where(F.col(key) == value).isEmpty():
        raise NotFound(f"no row with {key} = {value}")
    return rows


def recording_of(recordings: DataFrame, call: int) -> DataFrame:
    """A call's first recording."""
    return recordings.where(F.col("call_id") == call).orderBy("id").limit(1)


def set_status(calls: DataFrame, call: int, status: str, now: str) -> DataFrame:
    return updated(calls, "id", call, status=F.lit(status), updated_at=F.lit(now).cast("timestamp_ntz"))


def set_tags(calls: DataFrame, call: int, tags: list[str]) -> DataFrame:
    """Tags are kept as a JSON array; an error if there is no such call."""
    return updated(found(calls, "id", call), "id", call, tags=F.to_json(F.array(*[F.lit(t) for t in tags]).cast("array<string>")))


def tags_of(text: Column) -> Column:
    """A stored JSON array as an array; anything else is no tags."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def rename_analysis(analyses: DataFrame, call: int, title: str) -> DataFrame:
    return updated(analyses, "call_id", call, title=F.lit(title))


def name_voice(voice_prints: DataFrame, call: int, speaker: int, name: str) -> DataFrame:
    """Names one speaker of a call; an error if there is no such voice."""
    mine = (F.col("call_id") == call) & (F.col("speaker_id") == speaker)
    if voice_prints.where(mine).isEmpty():
        raise NotFound(f"no voice {speaker} in call {call}")
    return voice_prints.withColumn("name", F.when(mine, name).otherwise(F.col("name")))


def edit_transcript(transcripts: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """New JSON for some calls in place: ``created_at`` stays, ``updated_at`` moves on."""
    n = new.select("call_id", F.col("transcript_json").alias("new_json"))
    rows = transcripts.join(n, "call_id", "left")
    edited = F.col("new_json").isNotNull()
    return rows.withColumns(
        {"transcript_json": F.coalesce("new_json", "transcript_json"), "updated_at": F.when(edited, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at"))}
    ).select(*transcripts.columns)


def save_plugin_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upserts on (call_id, plugin); of several new rows for one key the latest counts."""
    newest = latest(new.withColumn("key_", F.struct("call_id", "plugin")), "key_", F.desc("created_at"), F.desc("payload")).drop("key_")
    return upserted(old, newest.select(*old.columns), "call_id", "plugin")


def commit_analyses(calls: DataFrame, analyses: DataFrame, new: DataFrame, status: str = "completed") -> tuple[DataFrame, DataFrame]:
    """Replaces calls' analyses and sets these calls' status, both or neither: (calls, analyses)."""
    done = new.select(F.col("call_id").alias("id")).distinct().withColumn("done_", F.lit(True))
    rows = calls.join(done, "id", "left").withColumn("status", F.when(F.col("done_"), status).otherwise(F.col("status")))
    return rows.select(*calls.columns), upserted(analyses, new, "call_id")


def add_recordings(recordings: DataFrame, new: DataFrame) -> DataFrame:
    return recordings.unionByName(new)


def delete_recordings(recordings: DataFrame, gone: DataFrame) -> DataFrame:
    return recordings.join(gone.select("id").distinct(), "id", "left_anti").select(*recordings.columns)


#: Rows that a task of a join sorts, about.
ROWS_A_TASK = 500_000


def set_audio_metadata(calls: DataFrame, recordings: DataFrame, measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Durations, channels and rates (by call_id) on calls and their recordings: (calls, recordings).

    Rows are dealt out by call over as many parts as they need, so that what a
    task sorts doesn't grow with them.
    """
    m = measured.select("call_id", *[F.col(c).alias(f"new_{c}") for c in ("duration_ms", "channels", "sample_rate")])
    take = lambda c: F.coalesce(f"new_{c}", c).alias(c)

    def with_new(rows: DataFrame, key: str) -> DataFrame:
        parts = -(-rows.count() // ROWS_A_TASK)
        if parts > 1:
            both = rows.repartition(parts, key).join(m.withColumnRenamed("call_id", key).repartition(parts, key), key, "left")
        else:
            both = rows.join(m.withColumnRenamed("call_id", key), key, "left")
        return both.select(*[take(c) if f"new_{c}" in m.columns else F.col(c) for c in rows.columns])

    return with_new(calls, "id"), with_new(recordings, "call_id")


def backfill(calls: DataFrame, recordings: DataFrame, headers: DataFrame) -> DataFrame:
    """(id, outcome, duration_ms) for each call without a duration: filled from its recording's header, or skipped.

    One join instead of pages: calls of which the recording or its header is
    missing are skipped.
    """
    first = latest(recordings, "call_id", F.asc("id")).select(F.col("call_id").alias("id"), "object_key")
    rows = calls.where("duration_ms IS NULL").select("id").join(first, "id", "left").join(headers.select("object_key", "duration_ms"), "object_key", "left")
    return rows.select("id", F.when(F.col("duration_ms").isNotNull(), "filled").otherwise("skipped").alias("outcome"), "duration_ms")


def labelled_json(rows: DataFrame, names: dict[int, str], json_col: str = "transcript_json") -> DataFrame:
    """``speaker_label`` set in the stored JSON of every segment of a named speaker, and how many changed.

    JSON of another shape stays as it is.
    """
    kind = "struct<segments:array<struct<sequence:bigint,speaker_id:bigint,speaker_label:string,text:string>>>"
    doc = F.from_json(json_col, kind)
    label = F.create_map(*[x for k, v in names.items() for x in (F.lit(k).cast("bigint"), F.lit(v))]) if names else F.create_map().cast("map<bigint,string>")
    new = F.transform(doc["segments"], lambda s: F.struct(s["sequence"].alias("sequence"), s["speaker_id"].alias("speaker_id"), F.coalesce(F.element_at(label, s["speaker_id"]), s["speaker_label"]).alias("speaker_label"), s["text"].alias("text")))
    n = F.coalesce(F.size(F.filter(doc["segments"], lambda s: F.map_contains_key(label, s["speaker_id"]))), F.lit(0))
    out = F.when((n > 0) & doc["segments"].isNotNull(), F.to_json(F.struct(new.alias("segments")))).otherwise(F.col(json_col))
    return rows.withColumn("changed", n).withColumn(json_col, out)


def rfc3339(at: Column) -> Column:
    """A UTC moment as RFC 3339 text."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_rfc3339(text: Column) -> Column:
    """The UTC moment of RFC 3339 text with any offset; null if it isn't one."""
    whole = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(whole, F.to_utc_timestamp(F.upper(text).try_cast("timestamp"), F.current_timezone())).cast("timestamp_ntz")
