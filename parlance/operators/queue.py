"""The work queue as functions from one table of jobs to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOCK_SECONDS = 3600
#: How often old locks are looked for.
REAP_SECONDS = 60


def heartbeat_seconds(lock_seconds: int = LOCK_SECONDS) -> int:
    """How often a lock is renewed: three times before it is old, every five seconds at most."""
    return max(lock_seconds // 3, 5)


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def backoff_seconds(attempt: Column) -> Column:
    """5 * 2 ** attempt, the attempt between 1 and 6."""
    return 5 * F.pow(F.lit(2), F.least(F.greatest(attempt, F.lit(1)), F.lit(6))).cast("bigint")


def enqueued(jobs: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """``jobs`` and new entries: pending, no attempts, due now unless they say otherwise."""
    row = new.withColumns({"status": F.lit("pending"), "attempt": F.lit(0).cast("bigint"), "run_after": F.coalesce("run_after", at(now)), "created_at": at(now)})
    return jobs.unionByName(row, allowMissingColumns=True)


def due(jobs: DataFrame, now: str, kinds: list[str] | None = None) -> DataFrame:
    rows = jobs.where((F.col("status") == "pending") & (F.col("run_after") <= at(now)) & (F.col("attempt") < F.col("max_attempts")))
    return rows.where(F.col("kind").isin(kinds)) if kinds else rows


def leased(jobs: DataFrame, now: str, workers: list[str], kinds: list[str] | None = None) -> DataFrame:
    """One due job for each worker: by priority, then how long it has been due, then age.

    The first jobs are a distributed top-k; only they are numbered.
    """
    first = due(jobs, now, kinds).orderBy(F.desc("priority"), "run_after", "created_at", "id").limit(len(workers))
    order = Window.partitionBy().orderBy(F.desc("priority"), "run_after", "created_at", "id")  # a row for each worker at most
    names = F.array(*[F.lit(w) for w in sorted(workers)])
    return first.withColumn("r_", F.row_number().over(order)).withColumns(
        {"status": F.lit("running"), "attempt": F.col("attempt") + 1, "locked_at": at(now), "locked_by": F.element_at(names, F.col("r_")), "last_error": F.lit(None).cast("string")}
    ).drop("r_")


def renewed(jobs: DataFrame, job: int, worker: str, now: str) -> DataFrame:
    """The lock's time moves on only for the holder of a running job."""
    mine = (F.col("id") == job) & (F.col("locked_by") == worker) & (F.col("status") == "running")
    return jobs.withColumn("locked_at", F.when(mine, at(now)).otherwise(F.col("locked_at")))


def _unlocked() -> dict[str, Column]:
    return {"locked_at": F.lit(None).cast("timestamp_ntz"), "locked_by": F.lit(None).cast("string")}


def _where(jobs: DataFrame, which: Column, changes: dict[str, Column]) -> DataFrame:
    return jobs.withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in changes.items()})


def _over(jobs: DataFrame, when: Column) -> dict[str, Column]:
    """The end's time, for tables that keep it."""
    return {"completed_at": when} if "completed_at" in jobs.columns else {}


def completed(jobs: DataFrame, which: Column, now: str | None = None) -> DataFrame:
    over = _over(jobs, at(now)) if now else {}
    return _where(jobs, which, {"status": F.lit("completed"), "last_error": F.lit(None).cast("string"), **over, **_unlocked()})


def failed(jobs: DataFrame, which: Column, error: Column, delay_seconds: Column, now: str) -> DataFrame:
    """With a delay the job is pending again after it, with none (null) it has failed and is over (``completed_at``, if the table has it)."""
    again = delay_seconds.isNotNull()
    later = at(now) + F.make_dt_interval(secs=F.coalesce(delay_seconds, F.lit(0)).cast("decimal(18,6)"))
    return _where(jobs, which, {"status": F.when(again, "pending").otherwise("failed"), "run_after": F.when(again, later).otherwise(F.col("run_after")), "last_error": error, **_over(jobs, F.when(again, F.col("completed_at") if "completed_at" in jobs.columns else None).otherwise(at(now))), **_unlocked()})


def stale(now: str, seconds: int) -> Column:
    return (F.col("status") == "running") & (F.col("locked_at") <= at(now) - F.make_dt_interval(secs=F.lit(seconds)))


def released(jobs: DataFrame, now: str, seconds: int = LOCK_SECONDS) -> DataFrame:
    """Running jobs with an old lock are pending, due now, behind what waited before."""
    return _where(jobs, stale(now, seconds), {"status": F.lit("pending"), "run_after": at(now), **_unlocked()})


def requeued(jobs: DataFrame, which: Column, kind: str | None = None) -> DataFrame:
    """Pending without having spent the attempt, as another kind (with no attempts) if one is given."""
    spent = F.lit(0).cast("bigint") if kind else F.greatest(F.col("attempt") - 1, F.lit(0))
    return _where(jobs, which, {"status": F.lit("pending"), "attempt": spent, **({"kind": F.lit(kind)} if kind else {}), **_unlocked()})


def outcome(result: Column, attempt: Column, max_attempts: Column) -> Column:
    """What follows a run: a struct (job status, call status, delay in seconds).

    ``result`` is ok, retryable, cancelled or anything else, which fails.
    """
    again = (result == "retryable") & (attempt < max_attempts)
    job = F.when(result == "ok", "completed").when(again | (result == "cancelled"), "pending").otherwise("failed")
    call = F.when(result == "ok", "completed").when(result == "cancelled", "pending").when(again, "processing").otherwise("failed")
    return F.struct(job.alias("job"), call.alias("call"), F.when(again, backoff_seconds(attempt)).alias("delay"))


def delivery(code: Column) -> Column:
    """A web hook's answer: ok, permanent or retryable."""
    return F.when((code >= 200) & (code < 300), "ok").when((code >= 400) & (code < 500), "permanent").otherwise("retryable")
