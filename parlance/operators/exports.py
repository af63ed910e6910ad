"""Transcripts as subtitle, text, Markdown, calendar, RTTM and JSON; RTTM read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import clock, mm_ss, speaker_label


def _joined(segments: DataFrame, piece: Column, mark: str = "") -> DataFrame:
    """One text for each call of ``piece`` in order of sequence; a call's segments are a bounded list."""
    rows = segments.select("call_id", "sequence", piece.alias("piece"), "end_ms")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sequence", "piece"))), lambda x: x["piece"])
    return rows.groupBy("call_id").agg(F.array_join(ordered, mark).alias("body"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


def _numbered(segments: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return segments.withColumn("no", F.row_number().over(Window.partitionBy("call_id").orderBy("sequence")))


def _who() -> Column:
    return speaker_label(F.col("speaker_role"), F.col("speaker_id"))


def srt(segments: DataFrame) -> DataFrame:
    piece = F.concat(F.col("no").cast("string"), F.lit("\n"), clock(F.col("start_ms"), ","), F.lit(" --> "), clock(F.col("end_ms"), ","), F.lit("\n["), _who(), F.lit("] "), F.col("raw_text"), F.lit("\n\n"))
    return _joined(_numbered(segments), piece).select("call_id", F.col("body").alias("srt"))


def vtt(segments: DataFrame, title: str = "Transcript") -> DataFrame:
    piece = F.concat(F.col("no").cast("string"), F.lit("\n"), clock(F.col("start_ms"), "."), F.lit(" --> "), clock(F.col("end_ms"), "."), F.lit("\n<v "), _who(), F.lit(">"), F.col("raw_text"), F.lit("\n\n"))
    return _joined(_numbered(segments), piece).select("call_id", F.concat(F.lit(f"WEBVTT - {title}\n\n"), "body").alias("vtt"))


def txt(segments: DataFrame) -> DataFrame:
    piece = F.concat(F.lit("["), mm_ss(F.col("start_ms")), F.lit("] "), _who(), F.lit(": "), F.col("raw_text"), F.lit("\n"))
    return _joined(segments, piece).select("call_id", F.col("body").alias("txt"))


def markdown(segments: DataFrame, title: str = "Conversation Transcript") -> DataFrame:
    piece = F.concat(F.lit("- **["), mm_ss(F.col("start_ms")), F.lit("] "), _who(), F.lit("**: "), F.col("raw_text"), F.lit("\n"))
    head = F.concat(F.lit(f"# {title}\n\n- **Duration:** "), mm_ss(F.col("end_ms")), F.lit("\n- **Total Segments:** "), F.col("n").cast("string"), F.lit("\n\n## Transcript\n\n"))
    return _joined(segments, piece).select("call_id", F.concat(head, "body").alias("markdown"))


def full_text(segments: DataFrame) -> DataFrame:
    piece = F.concat("speaker_role", F.lit(": "), "raw_text")
    return _joined(segments, piece, "\n").select("call_id", F.col("body").alias("full_text"))


def rttm(turns: DataFrame) -> DataFrame:
    """One line for each turn."""
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> speaker_%s <NA> <NA>", F.col("call_id").cast("string"), F.col("start_ms") / 1000.0, (F.col("end_ms") - F.col("start_ms")) / 1000.0, F.col("speaker_id").cast("string"))
    return turns.select("call_id", "turn", line.alias("line"))


def parsed_rttm(lines: DataFrame, line: str = "line") -> DataFrame:
    """SPEAKER lines with eight fields or more as (uri, speaker, start_ms, end_ms)."""
    f = F.split(F.trim(F.col(line)), r"\s+")
    rows = lines.select(f.alias("f")).where((F.size("f") >= 8) & (F.get("f", F.lit(0)) == "SPEAKER"))
    start, span = (F.round(F.get("f", F.lit(i)).try_cast("double") * 1000).cast("bigint") for i in (3, 4))
    return rows.select(F.get("f", F.lit(1)).alias("uri"), F.get("f", F.lit(7)).alias("speaker"), start.alias("start_ms"), (start + span).alias("end_ms")).where("start_ms IS NOT NULL AND end_ms IS NOT NULL")


def ics(rows: DataFrame, now: str, host: str = "calls.example") -> DataFrame:
    """A calendar event for each row (call_id, title, summary, location, start); a day from ``now`` if there is no start."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    at = F.lit(now).cast("timestamp_ntz")
    begin = F.coalesce(F.col("start"), at + F.expr("INTERVAL 24 HOURS"))
    one_line = lambda c: F.replace(c, F.lit("\n"), F.lit(" "))
    place = F.when(F.col("location").isNotNull(), F.concat(F.lit("LOCATION:"), "location"))
    parts = [
        F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit("PRODID:-//parlance//EN"), F.lit("CALSCALE:GREGORIAN"), F.lit("METHOD:PUBLISH"), F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), F.col("call_id").cast("string"), F.lit(f"@{host}")), F.concat(F.lit("DTSTAMP:"), stamp(at)), F.concat(F.lit("DTSTART:"), stamp(begin)),
        F.concat(F.lit("DTEND:"), stamp(begin + F.expr("INTERVAL 1 HOUR"))), F.concat(F.lit("SUMMARY:"), one_line(F.col("title"))), F.concat(F.lit("DESCRIPTION:"), one_line(F.col("summary"))),
        place, F.lit("STATUS:CONFIRMED"), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"), F.lit(""),
    ]
    return rows.select("call_id", F.concat_ws("\r\n", *parts).alias("ics"))


def nested(segments: DataFrame) -> DataFrame:
    """Each call's segments as one JSON array, in order."""
    seg = F.struct("sequence", "speaker_id", "speaker_role", "start_ms", "end_ms", F.col("raw_text").alias("text"))
    return segments.groupBy("call_id").agg(F.to_json(F.array_sort(F.collect_list(seg))).alias("json"))


def with_words(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Segments with their words as an array of structs, in order; a segment without words has none."""
    word = F.struct("pos", "word", "start_ms", "end_ms")
    own = words.groupBy("call_id", "sequence").agg(F.array_sort(F.collect_list(word)).alias("words"))
    return segments.join(own, ["call_id", "sequence"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<struct<pos:int,word:string,start_ms:bigint,end_ms:bigint>>")))


def words_of(segments: DataFrame) -> DataFrame:
    """The rows that ``with_words`` put together."""
    return segments.select("call_id", "sequence", F.inline("words"))


def web_hook(calls: DataFrame, analyses: DataFrame) -> DataFrame:
    """What a web hook is sent: no phone numbers."""
    rows = calls.join(analyses.withColumnRenamed("call_id", "id"), "id")
    return rows.select("id", F.to_json(F.struct(F.lit("call.completed").alias("event"), F.col("id").alias("call_id"), "external_id", "status", "title", "resolved")).alias("payload"))


#: By name; ``ics`` works on rows of events instead of segments.
FORMATS = {"srt": srt, "vtt": vtt, "md": markdown, "json": nested, "txt": txt}


def exported(segments: DataFrame, form: str) -> DataFrame:
    """(call_id, body) in the named form, plain text for any other name."""
    out = FORMATS.get(form, txt)(segments)
    return out.select("call_id", F.col(out.columns[1]).alias("body"))
