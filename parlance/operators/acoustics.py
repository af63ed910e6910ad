"""Who speaks where: the diarizers' choices, chunks of frame classes, windows for language detection, and their speed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators import clustering
from parlance.operators.conversation import diarized
from parlance.operators.joins import aligned
from parlance.operators.signal import upper_median

#: Which of three speakers each class of a frame has.
CLASSES = ((), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2))


def range_speakers(ranges: DataFrame, turns: DataFrame) -> DataFrame:
    """The speaker of each range (call_id, sequence, start_ms, end_ms): largest overlap, else nearest, 0 where a call has no turns."""
    rows = ranges.select("call_id", "sequence", F.lit(0).alias("pos"), F.lit("").alias("word"), "start_ms", "end_ms")
    return aligned(rows, turns).select("call_id", "sequence", F.coalesce("turn_speaker", F.lit(0)).alias("speaker_id"))


def frame_classes(rows: DataFrame, scores: str) -> DataFrame:
    """Vectors as frames of a call, ten chunks of forty frames each: the class with the largest of seven scores."""
    seven = F.slice(scores, 1, 7)
    div = lambda n: F.call_function("div", F.col("id"), F.lit(n).cast("bigint"))
    return rows.select(div(400).alias("call_id"), div(40).alias("chunk"), (F.array_position(seven, F.array_max(seven)) - 1).alias("class"))


def chunk_speech(frames: DataFrame) -> DataFrame:
    """Each call's share of frames with speech, and the (upper) median of its chunks' numbers of speakers, each 1 at least."""
    has = lambda who: F.max(F.col("class").isin([k for k, c in enumerate(CLASSES) if who in c]).cast("bigint"))
    chunks = frames.groupBy("call_id", "chunk").agg((has(0) + has(1) + has(2)).alias("speakers"), F.count("*").alias("n"), F.sum((F.col("class") > 0).cast("bigint")).alias("spoken"))
    return chunks.groupBy("call_id").agg(
        F.round(F.sum("spoken") / F.sum("n"), 6).alias("speech_ratio"), upper_median(F.collect_list(F.greatest("speakers", F.lit(1)))).cast("bigint").alias("speakers"), F.count("*").alias("chunks")
    )


def language_windows(calls: DataFrame, regions: DataFrame, first: int = 4, longest: int = 15_000) -> DataFrame:
    """What a language is detected from: a call's first regions, each cut to ``longest`` ms; without regions, windows spread evenly; without any, the whole call."""
    order = Window.partitionBy("call_id").orderBy("start_ms", "end_ms")
    cut = regions.withColumn("k", F.row_number().over(order)).where(F.col("k") <= first)
    spoken = cut.select("call_id", "start_ms", F.least("end_ms", F.col("start_ms") + longest).alias("end_ms")).join(calls.select("call_id"), "call_id", "left_semi")
    step = F.greatest(F.call_function("div", F.col("duration_ms"), F.lit(first + 1).cast("bigint")), F.lit(1000))
    silent = calls.join(regions.select("call_id").distinct(), "call_id", "left_anti").select("call_id", "duration_ms", step.alias("step"), F.explode(F.sequence(F.lit(1), F.lit(first))).alias("k"))
    even = silent.select("call_id", (F.col("k") * F.col("step")).alias("start_ms"), F.least(F.col("k") * F.col("step") + longest, "duration_ms").alias("end_ms"))
    windows = spoken.unionByName(even).where("start_ms < end_ms")
    whole = calls.join(windows.select("call_id").distinct(), "call_id", "left_anti").select("call_id", F.lit(0).cast("bigint").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    return windows.unionByName(whole)


def diarizer(mode: Column, channels: Column, has_model: Column) -> Column:
    """Separated stereo by its channels, all else by the neural diarizer, by acoustic clustering where that has no model."""
    return F.when((mode == "separated") & (channels == 2), "channels").when(has_model, "neural").otherwise("acoustic")


def speakers_wanted(hint: Column, counted: Column, most: Column) -> Column:
    """How many speakers to look for: the caller's hint, else what was counted, else 2; 1 to ``most``."""
    return F.greatest(F.least(F.coalesce(hint, counted, F.lit(2)), most), F.lit(1)).cast("bigint")


def turns_of_regions(regions: DataFrame, labels: DataFrame, calls: DataFrame) -> DataFrame:
    """Turns from labelled regions; a call without regions is one turn of speaker 0, and so is a call with one region."""
    n = regions.groupBy("call_id").agg(F.count("*").alias("n"))
    rows = regions.join(labels, ["call_id", "region"], "left").join(n, "call_id")
    spoken = rows.select("call_id", F.when(F.col("n") > 1, F.coalesce("label", F.lit(0))).otherwise(0).cast("int").alias("speaker_id"), "start_ms", "end_ms")
    silent = calls.join(n, "call_id", "left_anti").select("call_id", F.lit(0).alias("speaker_id"), F.lit(0).cast("bigint").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    return spoken.unionByName(silent)


def clustered_turns(regions: DataFrame, windows: DataFrame, hints: DataFrame, most: int = 4) -> DataFrame:
    """Turns by clustering a call's windows into as many speakers as ``hints`` (call_id, speakers) say, 2 without, 1 to ``most``.

    ``windows`` (call_id, id, window_start, window_end, embedding) lie over the
    regions, ids in order of time. A call with one region, or for one speaker,
    keeps its regions as turns of speaker 0; a call without regions has none.
    """
    calls = regions.groupBy("call_id").agg(F.count("*").alias("n")).join(hints.select("call_id", "speakers"), "call_id", "left")
    calls = calls.select("call_id", "n", speakers_wanted(F.col("speakers"), F.lit(None), F.lit(most)).alias("k"))
    alone = (F.col("n") == 1) | (F.col("k") == 1)
    kept = regions.join(calls.where(alone).select("call_id"), "call_id", "left_semi").select("call_id", F.lit(0).alias("speaker_id"), "start_ms", "end_ms")
    rows = windows.join(calls.where(~alone).select("call_id", "k"), "call_id")
    labels = clustering.by_call(rows, "call_id", lambda x, k: clustering.clustered(x, None, int(k)), given="k")
    return kept.unionByName(diarized(rows, labels).select("call_id", "speaker_id", "start_ms", "end_ms"))


def real_time_factors(runs: DataFrame) -> DataFrame:
    """Runs, audio and time taken for each engine, as a share of the audio."""
    rows = runs.groupBy("engine").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("audio_ms"), F.sum("took_ms").alias("took_ms"))
    return rows.select("engine", "n", "audio_ms", F.when(F.col("audio_ms") > 0, F.round(F.col("took_ms") / F.col("audio_ms"), 6)).alias("factor"))


def icon(kind: Column) -> Column:
    """What an entity's kind is shown as."""
    low, out = F.lower(kind), None
    for name, stems in (("place", "loc|place|address|floor|room"), ("person", "person|name"), ("phone", "phone"), ("time", "date|time"), ("money", "price|amount|money")):
        out = F.when(low.rlike(stems), name) if out is None else out.when(low.rlike(stems), name)
    return out.otherwise("tag")
