"""Regions of speech merged on a stream: as in a batch for any order within the watermark, late rows counted, no state left."""

import random
from datetime import datetime, timedelta

from parlance.operators import conversation
from parlance.streaming import jobs

SCHEMA = "call_id int, at timestamp, start_ms long, end_ms long, total_ms long"
START = datetime(2024, 1, 1)


def row(call, a, z):
    return call, START + timedelta(milliseconds=a), a, z, 60_000


def test_as_in_a_batch(spark, tmp_path):
    rng, rows = random.Random(3), []
    for call in range(6):
        at = rng.randrange(500)
        while at < 50_000:
            z = at + rng.choice([30, 100, 199, 200, 900])
            rows.append(row(call, at, z))
            at = z + rng.choice([1, 100, 299, 300, 301, 302, 2000])
    rows.sort(key=lambda r: r[2] + rng.randrange(3000))  # out of order, within the watermark
    batches = [rows[i::1][: len(rows) // 4] if i == 0 else rows[i * (len(rows) // 4) : (i + 1) * (len(rows) // 4) if i < 3 else None] for i in range(4)]
    late = [row(0, 10, 20)]
    for part in [*batches, [row(99, 500_000, 500_010)], late, [row(99, 900_000, 900_010)]]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = jobs.merged_regions(stream, late="5 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.call_id, r.start_ms, r.end_ms) for r in spark.read.schema("call_id int, start_ms long, end_ms long").parquet(f"{tmp_path}/out").collect())
    want = conversation.merged_intervals(spark.createDataFrame(rows, SCHEMA), "call_id")
    assert got == sorted((r.call_id, r.start_ms, r.end_ms) for r in want.collect()) and len(got) > 50
    progress = [p.stateOperators[0] for p in q.recentProgress]
    assert sum(p.numRowsDroppedByWatermark for p in progress) == 1 and max(p.numRowsTotal for p in progress) > 1 and progress[-1].numRowsTotal <= 1
