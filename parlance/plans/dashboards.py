"""Counts, lists and sweeps over calls and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import calls as C
from parlance.operators import queue as J
from parlance.sources import views as V
from parlance.sources.views import NOW, sql

STAMP = "yyyy-MM-dd HH:mm:ss"


def _day(df, *cols):
    return df.withColumns({c: F.date_format(c, STAMP) for c in cols})


def _display(s, d, want):
    return C.display_page(V.calls(s, d), V.transcripts(s, d), want, NOW).select("id", "external_id", "status", "primary_language", "is_favorite", "created_at")


QUERIES = {
    "job_counts_by_status": lambda s, d: C.job_counts(V.jobs(s, d)),
    "call_stats": lambda s, d: C.call_stats(V.calls(s, d)),
    "top_intents": lambda s, d: C.top_intents(V.analyses(s, d), 5),
    "daily_call_counts": lambda s, d: C.daily_counts(V.calls(s, d), 7),
    "daily_bars": lambda s, d: C.day_bars(C.daily_counts(V.calls(s, d), 30)),
    "language_distribution": lambda s, d: C.languages(V.transcripts(s, d)),
    "system_metrics": lambda s, d: C.system_metrics(V.jobs(s, d), V.calls(s, d)),
    "analytics_dashboard": lambda s, d: C.dashboard(V.calls(s, d), V.analyses(s, d), V.transcripts(s, d)),
    "call_lookup": lambda s, d: _day(V.calls(s, d).where("id = 7"), "created_at"),
    "call_by_external_id": lambda s, d: _day(V.calls(s, d).where("organization_id = 2 AND external_id = 'call-254'"), "created_at"),
    "call_list_page": lambda s, d: _day(C.listed(V.calls(s, d), C.CallFilter(organization_id=2, status="completed", created_from="1993-01-01", created_to="1997-12-31", limit=50, offset=10)), "created_at"),
    "call_list_display": lambda s, d: _day(_display(s, d, C.DisplayFilter(status="completed", language="en", text="call-1", limit=20)), "created_at"),
    "call_list_any_language": lambda s, d: _day(_display(s, d, C.DisplayFilter(language="ar", date="90d", limit=25, offset=5)), "created_at"),
    "call_list_total": lambda s, d: C.for_display(V.calls(s, d), V.transcripts(s, d), C.DisplayFilter(status="completed", language="en", text="call-1"), NOW).agg(F.count("*").alias("total")),
    "jobs_by_call": lambda s, d: _day(V.jobs(s, d).where("call_id = 3").select("id", "kind", "status", "created_at").orderBy(F.desc("created_at"), "id"), "created_at"),
    "last_job_error": lambda s, d: C.last_errors(V.jobs(s, d)),
    "awaited_plugins": lambda s, d: C.awaited(V.jobs(s, d).where("status = 'pending'"), V.jobs(s, d).where("status = 'completed'")),
    "named_speakers": lambda s, d: C.named_speakers(V.voice_prints(s, d), V.calls(s, d), 2).select("call_id", "speaker_id", "name"),
    "sweep_orphans_not_in": lambda s, d: C.orphans(V.calls(s, d), V.jobs(s, d)).agg(F.count("*").alias("n")),
    "sweep_orphans_not_in_some": lambda s, d: C.orphans(V.calls(s, d), V.jobs(s, d).where("call_id IS NOT NULL")).select("id", "status"),
    "sweep_orphans_intended": lambda s, d: C.orphans_intended(V.calls(s, d), V.jobs(s, d)).select("id", "status"),
    "sweep_covered_semi": lambda s, d: C.covered(V.calls(s, d), V.jobs(s, d)).select("id", "status"),
    "lease_next_jobs": lambda s, d: _day(J.leased(V.jobs(s, d), NOW, ["w1", "w2", "w3", "w4", "w5"], ["click", "view"]).select("id", "kind", "status", "attempt", "locked_by", "locked_at"), "locked_at"),
    "release_stale_locks": lambda s, d: _day(J.released(V.jobs(s, d), "2024-01-15 00:00:00").select("id", "status", "run_after", "locked_by"), "run_after"),
    "retry_backoff": lambda s, d: _day(
        J.failed(V.jobs(s, d), F.col("status") == "running", F.lit("lost"), F.when(F.col("attempt") < F.col("max_attempts"), J.backoff_seconds(F.col("attempt"))), NOW).select("id", "status", "run_after", "last_error"), "run_after"),
    "requeue_running": lambda s, d: J.requeued(V.jobs(s, d), F.col("status") == "running").select("id", "status", "attempt", "locked_by"),
    "requeue_as_kind": lambda s, d: J.requeued(V.jobs(s, d), F.col("status") == "running", "analyze").select("id", "kind", "status", "attempt"),
    "complete_jobs": lambda s, d: J.completed(V.jobs(s, d), F.col("locked_by") == "w1").select("id", "status", "locked_by", "last_error"),
    "job_outcomes": lambda s, d: V.jobs(s, d).withColumn("o", J.outcome(F.expr("CASE status WHEN 'completed' THEN 'ok' WHEN 'failed' THEN 'retryable' WHEN 'cancelled' THEN 'cancelled' ELSE 'broken' END"), F.col("attempt"), F.col("max_attempts"))).groupBy("o.job", "o.call", "o.delay").agg(F.count("*").alias("n")),
    "reprocess_fan_out": lambda s, d: C.reprocessing(V.calls(s, d)),
}

_LANG = "CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (WHERE primary_language IN ({0})) / count(*)) ELSE 0 END"
_HE, _RU = _LANG.format("'he','hebrew'"), _LANG.format("'ru','russian'")
_DISPLAY = "SELECT c.id, external_id, status, primary_language, is_favorite, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM calls c LEFT JOIN transcripts t ON t.call_id = c.id"
_FAILED = "SELECT id, CASE WHEN attempt < 3 THEN 'pending' ELSE 'failed' END AS status, strftime(CASE WHEN attempt < 3 THEN TIMESTAMP '2024-02-01' + to_seconds(5 * (2 ** least(greatest(attempt, 1), 6))::BIGINT) ELSE run_after END, '%Y-%m-%d %H:%M:%S') AS run_after, 'lost' AS last_error FROM jobs WHERE status = 'running' UNION ALL SELECT id, status, strftime(run_after, '%Y-%m-%d %H:%M:%S'), last_error FROM jobs WHERE status <> 'running'"
_RESULT = "CASE status WHEN 'completed' THEN 'ok' WHEN 'failed' THEN 'retryable' WHEN 'cancelled' THEN 'cancelled' ELSE 'broken' END"

SQL = {
    "job_counts_by_status": sql(V.JOBS, body="SELECT status, count(status) AS n FROM jobs GROUP BY status"),
    "call_stats": sql(V.CALLS, body="SELECT count(*) AS total, coalesce(sum((status = 'completed')::INT), 0)::BIGINT AS completed, round(coalesce(avg(duration_ms), 0), 4) AS avg_duration_ms, coalesce(sum(duration_ms), 0)::BIGINT AS sum_duration_ms FROM calls"),
    "top_intents": sql(V.ANALYSES, body="SELECT customer_intent, count(*) AS n FROM analyses WHERE customer_intent <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5"),
    "daily_call_counts": sql(V.CALLS, body="SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM calls GROUP BY 1 ORDER BY 1 DESC LIMIT 7"),
    "daily_bars": sql(V.CALLS, "t AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM calls GROUP BY 1 ORDER BY 1 DESC LIMIT 30)", body="SELECT day, n, greatest(8, 100 * n // max(n) OVER ())::BIGINT AS height FROM t"),
    "language_distribution": sql(V.TRANSCRIPTS, body="SELECT coalesce(primary_language, 'unknown') AS language, n FROM (SELECT primary_language, count(*) AS n FROM transcripts GROUP BY 1)"),
    "system_metrics": sql(V.JOBS, V.CALLS, body="SELECT *, (SELECT count(*) FROM calls) AS total, (SELECT count(*) FROM calls WHERE status = 'completed') AS completed, (SELECT round(coalesce(avg(duration_ms), 0), 4) FROM calls) AS avg_duration_ms, (SELECT coalesce(sum(duration_ms), 0)::BIGINT FROM calls) AS sum_duration_ms FROM (SELECT count(*) FILTER (WHERE status = 'pending') AS jobs_pending, count(*) FILTER (WHERE status = 'running') AS jobs_running, count(*) FILTER (WHERE status = 'completed') AS jobs_completed, count(*) FILTER (WHERE status = 'failed') AS jobs_failed FROM jobs)"),
    "analytics_dashboard": sql(V.CALLS, V.ANALYSES, V.TRANSCRIPTS, "t AS (SELECT customer_intent, count(*) AS n FROM analyses WHERE customer_intent <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5)", f"l AS (SELECT {_HE} AS he, {_RU} AS ru FROM transcripts)",
        body="SELECT 'hours' AS name, round(coalesce(sum(duration_ms), 0) / 3600000.0, 4)::DOUBLE AS value FROM calls UNION ALL SELECT 'completion_pct', round(100.0 * count(*) FILTER (WHERE status = 'completed') / count(*), 4) FROM calls UNION ALL SELECT 'intent:' || customer_intent, round(100.0 * n / sum(n) OVER ()) FROM t UNION ALL SELECT 'lang:he', he FROM l UNION ALL SELECT 'lang:ru', ru FROM l UNION ALL SELECT 'lang:en', 100 - he - ru FROM l"),
    "call_lookup": sql(V.CALLS, body="SELECT * REPLACE (strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at) FROM calls WHERE id = 7"),
    "call_by_external_id": sql(V.CALLS, body="SELECT * REPLACE (strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at) FROM calls WHERE organization_id = 2 AND external_id = 'call-254'"),
    "call_list_page": sql(V.CALLS, body="SELECT * REPLACE (strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at) FROM (SELECT * FROM calls WHERE organization_id = 2 AND status = 'completed' AND created_at >= TIMESTAMP '1993-01-01' AND created_at <= TIMESTAMP '1997-12-31' ORDER BY is_favorite DESC, created_at DESC, id LIMIT 50 OFFSET 10)"),
    "call_list_display": sql(V.CALLS, V.TRANSCRIPTS, body=f"{_DISPLAY} WHERE status = 'completed' AND primary_language IN ('en', 'english') AND external_id LIKE '%call-1%' ORDER BY is_favorite DESC, c.created_at DESC, id LIMIT 20"),
    "call_list_any_language": sql(V.CALLS, V.TRANSCRIPTS, body=f"{_DISPLAY} ORDER BY is_favorite DESC, c.created_at DESC, id LIMIT 25 OFFSET 5"),
    "call_list_total": sql(V.CALLS, V.TRANSCRIPTS, body="SELECT count(*) AS total FROM calls c LEFT JOIN transcripts t ON t.call_id = c.id WHERE status = 'completed' AND primary_language IN ('en', 'english') AND external_id LIKE '%call-1%'"),
    "jobs_by_call": sql(V.JOBS, body="SELECT id, kind, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM jobs WHERE call_id = 3"),
    "last_job_error": sql(V.JOBS, body="SELECT call_id, id, last_error FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY created_at DESC, id DESC) AS r FROM jobs WHERE call_id IS NOT NULL) WHERE r = 1 AND status = 'failed'"),
    "awaited_plugins": sql(V.JOBS, body="SELECT DISTINCT call_id, kind FROM jobs a WHERE status = 'pending' AND call_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM jobs b WHERE b.status = 'completed' AND b.call_id = a.call_id AND b.kind = a.kind)"),
    "named_speakers": sql(V.VOICE_PRINTS, V.CALLS, body="SELECT call_id, speaker_id, name FROM voice_prints v JOIN calls c ON c.id = v.call_id WHERE name IS NOT NULL AND organization_id = 2"),
    "sweep_orphans_not_in": sql(V.CALLS, V.JOBS, body="SELECT count(*) AS n FROM calls WHERE status = 'processing' AND id NOT IN (SELECT call_id FROM jobs WHERE status IN ('pending', 'running'))"),
    "sweep_orphans_not_in_some": sql(V.CALLS, V.JOBS, body="SELECT id, status FROM calls WHERE status = 'processing' AND id NOT IN (SELECT call_id FROM jobs WHERE status IN ('pending', 'running') AND call_id IS NOT NULL)"),
    "sweep_orphans_intended": sql(V.CALLS, V.JOBS, body="SELECT id, status FROM calls WHERE status = 'processing' AND NOT EXISTS (SELECT 1 FROM jobs WHERE status IN ('pending', 'running') AND call_id = calls.id)"),
    "sweep_covered_semi": sql(V.CALLS, V.JOBS, body="SELECT id, 'pending' AS status FROM calls WHERE status = 'processing' AND id IN (SELECT call_id FROM jobs WHERE status IN ('pending', 'running'))"),
    "lease_next_jobs": sql(V.JOBS, "t AS (SELECT * FROM jobs WHERE status = 'pending' AND run_after <= TIMESTAMP '2024-02-01' AND attempt < max_attempts AND kind IN ('click', 'view') ORDER BY priority DESC, run_after, created_at, id LIMIT 5)",
        body="SELECT id, kind, 'running' AS status, attempt + 1 AS attempt, 'w' || row_number() OVER (ORDER BY priority DESC, run_after, created_at, id) AS locked_by, '2024-02-01 00:00:00' AS locked_at FROM t"),
    "release_stale_locks": sql(V.JOBS, "t AS (SELECT *, status = 'running' AND locked_at <= TIMESTAMP '2024-01-14 23:00:00' AS old FROM jobs)", body="SELECT id, CASE WHEN old THEN 'pending' ELSE status END AS status, strftime(CASE WHEN old THEN TIMESTAMP '2024-01-15' ELSE run_after END, '%Y-%m-%d %H:%M:%S') AS run_after, CASE WHEN old THEN NULL ELSE locked_by END AS locked_by FROM t"),
    "retry_backoff": sql(V.JOBS, body=_FAILED),
    "requeue_running": sql(V.JOBS, body="SELECT id, CASE WHEN status = 'running' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'running' THEN greatest(attempt - 1, 0) ELSE attempt END AS attempt, CASE WHEN status = 'running' THEN NULL ELSE locked_by END AS locked_by FROM jobs"),
    "requeue_as_kind": sql(V.JOBS, body="SELECT id, 'analyze' AS kind, 'pending' AS status, 0::BIGINT AS attempt FROM jobs WHERE status = 'running' UNION ALL SELECT id, kind, status, attempt FROM jobs WHERE status <> 'running'"),
    "complete_jobs": sql(V.JOBS, body="SELECT id, CASE WHEN locked_by = 'w1' THEN 'completed' ELSE status END AS status, CASE WHEN locked_by = 'w1' THEN NULL ELSE locked_by END AS locked_by, CASE WHEN locked_by = 'w1' THEN NULL ELSE last_error END AS last_error FROM jobs"),
    "job_outcomes": sql(V.JOBS, f"t AS (SELECT *, {_RESULT} AS r FROM jobs)",
        body="SELECT CASE WHEN r = 'ok' THEN 'completed' WHEN r = 'cancelled' OR (r = 'retryable' AND attempt < 3) THEN 'pending' ELSE 'failed' END AS job, CASE WHEN r = 'ok' THEN 'completed' WHEN r = 'cancelled' THEN 'pending' WHEN r = 'retryable' AND attempt < 3 THEN 'processing' ELSE 'failed' END AS call, CASE WHEN r = 'retryable' AND attempt < 3 THEN (5 * 2 ** least(greatest(attempt, 1), 6))::BIGINT END AS delay, count(*) AS n FROM t GROUP BY ALL"),
    "reprocess_fan_out": sql(V.CALLS, body="SELECT id AS call_id, 'analyze' AS kind, 'pending' AS status, 0::BIGINT AS attempt FROM calls WHERE status = 'completed'"),
}
