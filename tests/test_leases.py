"""Leases over several batches of a stream, with a clock that the events drive, against a plain simulation."""

import random
import time
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from parlance.streaming import jobs, leases

START = datetime(2024, 1, 1)
LOCK = 100


def plain(events, end):
    """(job, status, worker, attempt, at, lock_ends) by walking through each job's events; locks end up to second ``end``."""
    out = []
    for job in {e[0] for e in events}:
        lease = None
        for _, kind, worker, attempt, at in sorted((e for e in events if e[0] == job), key=lambda e: (e[4], e[1], e[2])):
            if lease and lease[2] <= at:
                out.append((job, "pending", lease[0], lease[1], lease[2], None))
                lease = None
            if (kind == "lease" and not lease) or (kind == "heartbeat" and lease and lease[0] == worker):
                lease = (worker, lease[1] if lease else attempt, at + LOCK)
                out.append((job, "running", worker, lease[1], at, lease[2]))
            elif kind in ("complete", "fail") and lease and lease[0] == worker:
                out.append((job, "completed" if kind == "complete" else "failed", worker, lease[1], at, None))
                lease = None
            else:
                out.append((job, "refused", worker, attempt, at, None))
        if lease and lease[2] <= end:
            out.append((job, "pending", lease[0], lease[1], lease[2], None))
    return sorted(out, key=str)


def stamped(second):
    return START + timedelta(seconds=second)


def streamed(spark, folder, batches, **options):
    """The changes of a stream that gets one file for each batch, and the rows that its state ends with."""
    for k, events in enumerate(batches):
        rows = spark.createDataFrame([(*e[:4], stamped(e[4])) for e in events], leases.EVENTS)
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(leases.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    places, last = [], []

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        places.append(f"{folder}/out/{number}")

    with jobs.keyed_state(spark):
        out = leases.leases(stream, LOCK, **options).writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint")
        if options:
            q = out.trigger(availableNow=True).start()
            q.awaitTermination()
        else:  # with timers of the machine's clock a stream never ends by itself
            q = out.trigger(processingTime="1 second").start()
            for _ in range(240):
                time.sleep(0.5)
                if spark.read.schema(leases.CHANGES).parquet(*list(places)).count() if places else 0:
                    break
            q.stop()
        last = [p.stateOperators[0].numRowsTotal for p in q.recentProgress]
    return spark.read.schema(leases.CHANGES).parquet(*places), last


def test_batches_and_timers(spark, tmp_path):
    rng = random.Random(4)
    events = sorted(((rng.randrange(8), rng.choice(["lease", "heartbeat", "heartbeat", "complete", "fail"]), rng.choice("ab"), rng.randrange(3), rng.randrange(3000)) for _ in range(300)), key=lambda e: e[4])
    batches = [events[i : i + 60] for i in range(0, 300, 60)] + [[(99, "heartbeat", "x", 0, 10_000)]]
    changes, state = streamed(spark, tmp_path, batches, event_time=True)
    got = [(r.job_id, r.status, r.worker, r.attempt, r.at, r.lock_ends) for r in changes.collect()]
    want = [(j, s, w, a, stamped(at), None if ends is None else stamped(ends)) for j, s, w, a, at, ends in plain(events + batches[-1], 10_000)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {s for _, s, *_ in got} == {"running", "completed", "failed", "pending", "refused"}
    assert max(state) > 0 and state[-1] == 0 and leases.running(changes).count() == 0


def test_a_missed_heartbeat_gives_the_job_back(spark, tmp_path):
    batches = [[(1, "lease", "a", 1, 0), (2, "lease", "b", 1, 0)], [(1, "heartbeat", "a", 1, 60), (1, "heartbeat", "b", 1, 61)], [(3, "heartbeat", "z", 0, 130)], [(2, "heartbeat", "b", 1, 140), (2, "lease", "c", 2, 141)]]
    changes, _ = streamed(spark, tmp_path, batches, event_time=True)
    by = {j: [(r.status, r.worker, r.at) for r in changes.where(F.col("job_id") == j).orderBy("at", "status").collect()] for j in (1, 2)}
    assert by[1] == [("running", "a", stamped(0)), ("running", "a", stamped(60)), ("refused", "b", stamped(61))]
    assert by[2] == [("running", "b", stamped(0)), ("pending", "b", stamped(100)), ("refused", "b", stamped(140)), ("running", "c", stamped(141))]
    assert [(r.job_id, r.worker, r.attempt) for r in leases.running(changes).orderBy("job_id").collect()] == [(1, "a", 1), (2, "c", 2)]


def test_the_machines_clock(spark, tmp_path):
    changes, _ = streamed(spark, tmp_path, [[(1, "lease", "a", 1, 0), (1, "complete", "b", 1, 1), (1, "complete", "a", 1, 2)]])
    assert [r.status for r in changes.orderBy("at").collect()] == ["running", "refused", "completed"]


def test_state_is_read_and_written_once_a_batch():
    calls = []

    class Far:
        def __getattr__(self, name):
            return lambda *x: calls.append(name) or (("a", 1, 5) if name == "get" else name == "exists")

    holder = leases.Holder(LOCK * 1000, True)
    holder.handle = holder.lease = Far()
    rows = pd.DataFrame([(1, "lease", "a", 1, pd.Timestamp(stamped(10 * i))) for i in range(50)], columns=["job_id", "kind", "worker", "attempt", "at"])
    (out,) = holder.handleInputRows((1,), iter([rows]), None)
    assert len(out) == 55 and len(calls) <= 5  # the old lock's end and those of the four leases before the last
