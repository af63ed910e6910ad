"""Operators on ordered speech: metrics, segmentation, turn merging, sliding windows, roles, packing."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import estimated_tokens, is_greeting

MIN_SILENCE_MS, PAUSE_MS, TURN_GAP_MS = 500, 1500, 200


def _in_order(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order)


def conversation_metrics(segments: DataFrame) -> DataFrame:
    """Talk, silence, switches and monologues of each call.

    Columns needed: call_id, sequence, speaker_id, speaker_role, start_ms,
    end_ms, n_words. A gap counts from the row before (the first from 0) and
    from 500 ms on; the duration is the last row's end; ratios know agents and
    customers only; a monologue is a run of one role. All windows and both
    aggregations share one partitioning by call.
    """
    w = _in_order("call_id", "sequence")
    gap = F.greatest(F.col("start_ms") - F.lag("end_ms", 1, 0).over(w), F.lit(0))
    rows = segments.select(
        "call_id", "sequence", "speaker_role", "n_words", "end_ms",
        F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)).alias("dur"),
        F.when(gap >= MIN_SILENCE_MS, gap).otherwise(0).alias("silence"),
        F.when(F.lag("speaker_id").over(w) != F.col("speaker_id"), 1).otherwise(0).alias("switch"),
        F.when(F.lag("speaker_role").over(w).eqNullSafe(F.col("speaker_role")), 0).otherwise(1).alias("new_run"),
    )
    rows = rows.withColumn("run", F.sum("new_run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("call_id", "run", "speaker_role").agg(
        F.sum("dur").alias("dur"), F.sum("n_words").alias("n_words"), F.sum("silence").alias("silence"), F.sum("switch").alias("switch"),
        F.count("*").alias("n"), F.max("sequence").alias("last"), F.max_by("end_ms", "sequence").alias("end"),
    )
    of = lambda role, c: F.coalesce(F.sum(F.when(F.col("speaker_role") == role, F.col(c))), F.lit(0))
    longest = lambda role: F.coalesce(F.max(F.when(F.col("speaker_role") == role, F.col("dur"))), F.lit(0))
    out = runs.groupBy("call_id").agg(
        F.sum("n").alias("n_segments"), F.max_by("end", "last").alias("duration_ms"), F.sum("silence").alias("silence_ms"), F.sum("switch").alias("speaker_switches"),
        of("agent", "dur").alias("agent_ms"), of("customer", "dur").alias("customer_ms"), of("agent", "n_words").alias("agent_words"), of("customer", "n_words").alias("customer_words"),
        longest("agent").alias("agent_monologue_ms"), longest("customer").alias("customer_monologue_ms"),
    )
    talk = F.greatest(F.col("agent_ms") + F.col("customer_ms"), F.lit(1))
    rate = lambda who: F.when(F.col(f"{who}_ms") > 0, F.round(F.col(f"{who}_words") * 60_000.0 / F.col(f"{who}_ms"), 4)).otherwise(F.lit(0.0))
    return out.select(
        "*", F.round(F.col("agent_ms") / talk, 6).alias("agent_ratio"), F.round(F.col("customer_ms") / talk, 6).alias("customer_ratio"),
        rate("agent").alias("agent_wpm"), rate("customer").alias("customer_wpm"),
    )


def segmented(words: DataFrame, order: str = "ordinal") -> DataFrame:
    """Words to segments: a new one where the speaker or language changes or a pause exceeds 1,500 ms.

    Columns needed: call_id, ``order``, word, speaker_id, language, start_ms,
    end_ms. A null speaker is 0, a null language unknown; a segment ends with
    its last word.
    """
    w = _in_order("call_id", order)
    rows = words.select("call_id", F.col(order).alias("ordinal"), "word", F.coalesce("speaker_id", F.lit(0)).alias("speaker_id"), F.coalesce("language", F.lit("unknown")).alias("language"), "start_ms", "end_ms")
    w = _in_order("call_id", "ordinal")
    same = (F.lag("speaker_id").over(w) == F.col("speaker_id")) & (F.lag("language").over(w) == F.col("language")) & (F.col("start_ms") <= F.lag("end_ms").over(w) + PAUSE_MS)
    rows = rows.withColumn("new", F.when(same, 0).otherwise(1))
    rows = rows.withColumn("sequence", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "word"))), lambda x: x["word"]), " ")
    return rows.groupBy("call_id", "sequence").agg(
        F.min_by("speaker_id", "ordinal").alias("speaker_id"), F.min_by("language", "ordinal").alias("language"),
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "ordinal").alias("end_ms"), F.count("*").alias("n_words"), text.alias("text"),
    )


def merged_turns(turns: DataFrame, gap_ms: int = TURN_GAP_MS) -> DataFrame:
    """Neighbouring turns of one speaker joined where the next begins within ``gap_ms`` of the joined turn's end.

    Within a run of one speaker the joined end is the running maximum, since
    turns are in order of their start.
    """
    w = _in_order("call_id", "start_ms", "turn")
    rows = turns.withColumn("change", F.when(F.lag("speaker_id").over(w) == F.col("speaker_id"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy("call_id", "run").orderBy("start_ms", "turn")
    reach = F.max("end_ms").over(r.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("start_ms") <= reach + gap_ms, 0).otherwise(1))
    rows = rows.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("call_id", "part").agg(F.min("speaker_id").alias("speaker_id"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_turns"))


def merged_intervals(rows: DataFrame, key: str, gap_ms: int = 300, least_ms: int = 200, pad_ms: int = 100) -> DataFrame:
    """Intervals joined over gaps up to ``gap_ms``, short ones dropped, the others widened within 0 and ``total_ms``."""
    w = _in_order(key, "start_ms", "end_ms")
    rows = rows.withColumn("new", F.when(F.col("start_ms") - F.lag("end_ms").over(w) <= gap_ms, 0).otherwise(1))
    rows = rows.withColumn("region", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = rows.groupBy(key, "region").agg(F.min("start_ms").alias("s"), F.max_by("end_ms", F.struct("start_ms", "end_ms")).alias("e"), F.max("total_ms").alias("total_ms"))
    joined = joined.where(F.col("e") - F.col("s") >= least_ms)
    return joined.select(key, "region", F.greatest(F.col("s") - pad_ms, F.lit(0)).alias("start_ms"), F.least(F.col("e") + pad_ms, F.col("total_ms")).alias("end_ms"))


def sliding_windows(regions: DataFrame, size: int = 800, hop: int = 400, least: int = 50) -> DataFrame:
    """Windows of ``size`` every ``hop`` ms over each region, a shorter one for what is left at the end.

    A region not longer than ``size`` is its own window; windows up to
    ``least`` ms are dropped.
    """
    last = F.col("end_ms") - size
    starts = F.when(last <= F.col("start_ms"), F.array("start_ms")).otherwise(F.sequence(F.col("start_ms"), last, F.lit(hop).cast("bigint")))
    rows = regions.withColumn("starts", starts)
    tail = F.element_at("starts", -1) + hop
    more = F.when((last > F.col("start_ms")) & (F.element_at("starts", -1) + size < F.col("end_ms")), F.array(tail)).otherwise(F.array().cast("array<bigint>"))
    keep = [c for c in regions.columns if c not in ("start_ms", "end_ms")]
    rows = rows.select(*keep, "end_ms", F.posexplode(F.concat("starts", more)).alias("window", "window_start"))
    rows = rows.withColumn("window_end", F.least(F.col("window_start") + size, F.col("end_ms")))
    return rows.where(F.col("window_end") - F.col("window_start") > least).drop("end_ms")


def speaker_roles(segments: DataFrame, first: int = 4) -> DataFrame:
    """Each speaker's role: who greets within the first ``first`` segments is the agent and all others customers; else 0 and 1."""
    w = _in_order("call_id", "sequence")
    rows = segments.withColumn("r", F.row_number().over(w))
    greets = (F.col("r") <= first) & is_greeting(F.col("raw_text"))
    agent = F.min_by(F.when(greets, F.col("speaker_id")), F.when(greets, F.col("r"))).over(Window.partitionBy("call_id"))
    rows = rows.select("call_id", "speaker_id", agent.alias("agent")).distinct()
    by_number = F.when(F.col("speaker_id") == 0, "agent").when(F.col("speaker_id") == 1, "customer").otherwise("unknown")
    role = F.when(F.col("agent").isNull(), by_number).when(F.col("speaker_id") == F.col("agent"), "agent").otherwise("customer")
    return rows.select("call_id", "speaker_id", role.alias("role"))


def stereo_roles(segments: DataFrame, first: int = 3) -> DataFrame:
    """Separated channels: the right speaker is the agent if one of their first ``first`` segments greets, else the left one."""
    w = Window.partitionBy("call_id", "speaker_id").orderBy("sequence")
    right = segments.withColumn("r", F.row_number().over(w)).groupBy("call_id").agg(F.max(F.coalesce(is_greeting(F.col("raw_text")) & (F.col("speaker_id") == 1) & (F.col("r") <= first), F.lit(False))).alias("right"))
    return right.select("call_id", F.when(F.col("right"), 1).otherwise(0).alias("agent_speaker"), F.when(F.col("right"), 0).otherwise(1).alias("customer_speaker"))


def speaker_metadata(segments: DataFrame) -> DataFrame:
    """Talk time and words of each speaker; the role is that of the first segment."""
    return segments.groupBy("call_id", "speaker_id").agg(
        F.min_by("speaker_role", "sequence").alias("role"), F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("talk_time_ms"), F.sum("n_words").alias("word_count")
    )


def window_numbers(costs: Iterable[int], budget: int) -> list[int]:
    """The window of each line, lines packed one after the other into windows of ``budget``; a larger line is alone."""
    window = used = 0
    out = []
    for cost in costs:
        if used and used + cost > budget:
            window, used = window + 1, 0
        used += cost
        out.append(window)
    return out


def packed_lines(rows: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """Lines packed one after the other into windows of ``budget`` estimated tokens; a larger line is alone.

    One pass over each text's lines with the window's fill as state: a window
    can't start anew from what a running sum knows, and a fold that appends to
    an array would take time with the square of the lines.
    """

    @F.pandas_udf("array<int>")
    def windows(costs: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else window_numbers(c, budget) for c in costs])

    lines = F.split(text, "\n", -1)
    costs = F.transform(lines, lambda line: F.ceil((F.length(line) + 1) / 3).cast("bigint"))
    parts = rows.select(key, costs.alias("costs")).withColumn("at", windows("costs"))
    pairs = parts.select(key, F.posexplode(F.arrays_zip("costs", "at")).alias("pos", "x"))
    return pairs.groupBy(key, F.col("x.at").alias("window")).agg(F.count("*").alias("n_lines"), F.sum("x.costs").alias("tokens"), F.min("pos").alias("first_line"))


def opening(segments: DataFrame, limit: int = 280) -> DataFrame:
    """A call's first words: trimmed segments joined until ``limit`` characters are there, cut with an ellipsis."""
    text = F.trim("raw_text")
    rows = segments.where(text != "").select("call_id", "sequence", text.alias("t"))
    w = _in_order("call_id", "sequence").rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum(F.length("t") + 1).over(w) - 1
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < limit)
    whole = rows.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "t"))), lambda x: x["t"]), " ").alias("t"))
    return whole.select("call_id", F.when(F.length("t") > limit, F.concat(F.substring("t", 1, limit), F.lit("…"))).otherwise(F.col("t")).alias("opening"))


def prompt_lines(segments: DataFrame) -> DataFrame:
    """``[i] (mm:ss) label: text`` for each segment, and its estimated tokens."""
    from parlance.functions.text import mm_ss, speaker_label

    line = F.concat(F.lit("["), F.col("sequence").cast("string"), F.lit("] ("), mm_ss(F.col("start_ms")), F.lit(") "), speaker_label(F.col("speaker_role"), F.col("speaker_id")), F.lit(": "), F.col("raw_text"))
    return segments.select("call_id", "sequence", line.alias("line")).withColumn("tokens", estimated_tokens(F.col("line")))


def words_of_tokens(tokens: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """A recogniser's tokens as words: a token that begins with a blank begins a word.

    Columns needed: call_id, ordinal, token, start_ms, end_ms, probability; with
    ``segments`` (call_id, segment, start_ms, end_ms, text) also segment, and no
    word crosses a segment's end. Control tokens (``[_``) don't count. A token
    lies within its segment and lasts 30 ms at least. A word has its tokens'
    texts in a row without blanks at its ends, ends where its last token does
    but 40 ms after its start at least, and has their mean probability; words
    without text are dropped. A segment that no word is left of gets those of
    its text, in even parts of 50 ms at least.
    """
    group = ["call_id"] if segments is None else ["call_id", "segment"]
    rows = tokens.where(~F.col("token").startswith("[_"))
    if segments is not None:
        spans = segments.select("call_id", "segment", F.col("start_ms").alias("from_"), F.col("end_ms").alias("to_"))
        rows = rows.join(spans, group).withColumn("start_ms", F.greatest("start_ms", "from_")).withColumn("end_ms", F.greatest(F.least("end_ms", "to_"), F.col("start_ms") + 30)).drop("from_", "to_")
    w = Window.partitionBy(*group).orderBy("ordinal")
    rows = rows.withColumn("new", F.when(F.col("token").rlike(r"^[ \n\t]"), 1).otherwise(0))
    rows = rows.withColumn("word_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.btrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "token"))), lambda x: x["token"]), ""), F.lit(" \n\t"))
    start, sure = F.min_by("start_ms", "ordinal"), F.greatest(F.least(F.avg("probability"), F.lit(1.0)), F.lit(0.0))
    out = rows.groupBy(*group, "word_no").agg(text.alias("word"), start.alias("start_ms"), F.greatest(F.max_by("end_ms", "ordinal"), start + 40).alias("end_ms"), sure.alias("confidence"))
    out = out.where("word <> ''")
    if segments is None:
        return out
    bare = segments.join(out.select(*group).distinct(), group, "left_anti").withColumn("ws", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).where(F.size("ws") > 0)
    part = F.greatest(F.call_function("div", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)), F.size("ws").cast("bigint")), F.lit(50))
    bare = bare.select(*group, F.col("start_ms").alias("from_"), F.col("end_ms").alias("to_"), part.alias("part"), F.posexplode("ws").alias("k", "word"))
    start = F.col("from_") + F.col("k") * F.col("part")
    even = bare.select(*group, F.col("k").cast("bigint").alias("word_no"), "word", start.alias("start_ms"), F.greatest(F.least(start + F.col("part"), F.col("to_")), start + 40).alias("end_ms"), F.lit(0.9).alias("confidence"))
    return out.unionByName(even)


def counting_windows(regions: DataFrame, size: int = 2000, hop: int = 1000, most: int = 256) -> DataFrame:
    """Longer windows for counting speakers; of a call's n windows every ceil(n / ``most``)th is taken."""
    rows = sliding_windows(regions, size, hop)
    w = Window.partitionBy("call_id")
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("window_start", "window_end")) - 1)
    return rows.where(F.col("r") % F.ceil(F.col("n") / most) == 0).drop("n", "r")


def fixed_chunks(calls: DataFrame, length_ms: int = 10_000) -> DataFrame:
    """Chunks of equal length over each call's ``duration_ms``, with how much of the last one is real."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("duration_ms") - 1, F.lit(0)), F.lit(length_ms).cast("bigint"))
    rows = calls.where("duration_ms > 0").select("call_id", "duration_ms", F.posexplode(starts).alias("chunk", "start_ms"))
    return rows.select("call_id", "chunk", "start_ms", F.least(F.col("duration_ms") - F.col("start_ms"), F.lit(length_ms)).alias("real_ms"))


def renumbered(rows: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """Labels numbered within each group by where they first appear."""
    first = F.min(order).over(Window.partitionBy(group, label))
    return rows.withColumn("first_", first).withColumn("number", F.dense_rank().over(Window.partitionBy(group).orderBy("first_")) - 1).drop("first_")


def diarized(windows: DataFrame, labels: DataFrame, gap_ms: int = TURN_GAP_MS) -> DataFrame:
    """Turns from labelled windows (call_id, id, window_start, window_end) and (call_id, id, cluster)."""
    turns = windows.join(labels, ["call_id", "id"]).select("call_id", F.col("id").alias("turn"), F.col("cluster").alias("speaker_id"), F.col("window_start").alias("start_ms"), F.col("window_end").alias("end_ms"))
    return merged_turns(turns, gap_ms)


def stereo_turns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Speech regions of two channels (call_id, start_ms, end_ms) as turns of speakers 0 and 1, in order of time."""
    both = left.select("call_id", F.lit(0).alias("speaker_id"), "start_ms", "end_ms").unionByName(right.select("call_id", F.lit(1).alias("speaker_id"), "start_ms", "end_ms"))
    return both.withColumn("turn", F.row_number().over(_in_order("call_id", "start_ms", "speaker_id")) - 1)


def valid_transcripts(segments: DataFrame) -> DataFrame:
    """Calls whose segments all have ids, speakers of 16 bits and times in order; a call without segments is not valid."""
    bad = F.col("sequence").isNull() | (F.coalesce("speaker_id", F.lit(0)) < 0) | (F.coalesce("speaker_id", F.lit(0)) > 65_535) | (F.col("end_ms") < F.col("start_ms"))
    return segments.groupBy("call_id").agg(F.count("*").alias("n_segments"), F.count_if(F.coalesce(bad, F.lit(True))).alias("n_bad")).where("n_bad = 0").drop("n_bad")
