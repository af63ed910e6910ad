"""Streams over the model: running counts of jobs, segments of timed words as they come."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parlance.operators.conversation import PAUSE_MS


def job_counts(events: DataFrame, delay: str = "1 hour", span: str = "1 day") -> DataFrame:
    """Jobs by kind in windows of event time; what comes later than ``delay`` is dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", span).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def merged_regions(intervals: DataFrame, gap_ms: int = 300, least_ms: int = 200, pad_ms: int = 100, late: str = "10 seconds") -> DataFrame:
    """Intervals of speech joined over gaps up to ``gap_ms`` as they come, in append mode.

    Columns needed: call_id, at (when the interval begins), start_ms, end_ms and
    total_ms. An interval is a session that ends ``gap_ms`` after it, so the gap
    is each row's own; sessions that meet are one. Short ones are dropped, the
    others widened within 0 and total_ms. A region comes out once the watermark,
    ``late`` behind the newest interval, has passed it, and its state goes;
    intervals that come later still are dropped and counted in the query's
    progress.
    """
    # sessions that only touch are one, so a gap of just gap_ms joins
    length = F.concat((F.col("end_ms") - F.col("start_ms") + gap_ms).cast("string"), F.lit(" milliseconds"))
    rows = intervals.withWatermark("at", late).groupBy("call_id", F.session_window("at", length).alias("s"))
    out = rows.agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("z"), F.max("total_ms").alias("total_ms")).where(F.col("z") - F.col("a") >= least_ms)
    return out.select("call_id", F.greatest(F.col("a") - pad_ms, F.lit(0)).alias("start_ms"), F.least(F.col("z") + pad_ms, F.col("total_ms")).alias("end_ms"))


class Segmenter(StatefulProcessor):
    """Keeps each call's open segment; a change of speaker or a long pause closes it. With ``idle_ms`` it is forgotten after that time."""

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    SCHEMA = "call_id bigint, sequence bigint, speaker_id int, start_ms bigint, end_ms bigint, n_words bigint, text string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "sequence bigint, speaker_id int, start_ms bigint, end_ms bigint, n_words bigint, text string", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        words = pd.concat(list(rows)).sort_values("ordinal")
        now = self.open.get() if self.open.exists() else None
        out = []
        for w in words.itertuples():
            if now is not None and now[1] == w.speaker_id and w.start_ms <= now[3] + PAUSE_MS:
                now = (now[0], now[1], now[2], int(w.end_ms), now[4] + 1, f"{now[5]} {w.word}")
                continue
            if now is not None:
                out.append((key[0], *now))
            now = (0 if now is None else now[0] + 1, int(w.speaker_id), int(w.start_ms), int(w.end_ms), 1, w.word)
        self.open.update(now)
        # the open segment goes out too; a later row with its sequence replaces it
        out.append((key[0], *now))
        yield pd.DataFrame(out, columns=["call_id", "sequence", "speaker_id", "start_ms", "end_ms", "n_words", "text"])

    def close(self) -> None:
        pass


def segments(words: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Segments as words come, in update mode: (call_id, sequence) is the key that a sink replaces.

    A stream that runs on should say after how long without words a call is
    forgotten (``idle_ms``, by the machine's clock); one over what is there
    already ends with its input and keeps its state till then.
    """
    return words.groupBy("call_id").transformWithStateInPandas(Segmenter(idle_ms), Segmenter.SCHEMA, "Update", "ProcessingTime" if idle_ms else "None")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State of single keys needs a store that can look them up; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def run_to_end(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """All that is there, as a table in ``folder``; for bounded inputs.

    A batch is written to a place of its own, so that one that is run again
    replaces what it had written; in complete mode the newest batch is all.
    """
    spark, schema, written = stream.sparkSession, stream.schema, []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        written.append(f"{folder}/batch-{number}")

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    places = sorted(set(written))
    return spark.read.schema(schema).parquet(*(places if mode != "complete" else written[-1:])) if written else spark.createDataFrame([], schema)


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table's file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(sf_dir, pathGlobFilter="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
