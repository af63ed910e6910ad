"""Writes as table rewrites, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import calls as C
from parlance.operators.records import commit_analyses
from parlance.sources import views as V
from parlance.sources.scratch import scratch
from parlance.sources.views import sql
from parlance.streaming import jobs as J
from parlance.streaming import leases


def _upsert(s, d):
    old = V.transcripts(s, d).select("call_id", "primary_language")
    new = old.where("call_id % 3 = 0").select((F.col("call_id") + 5).alias("call_id"), F.lit("xx").alias("primary_language"))
    return C.upserted(old, new, "call_id")


def _analysis(s, d):
    """The calls after analyses were replaced for some of them."""
    old = V.analyses(s, d).select("call_id", "title")
    return commit_analyses(V.calls(s, d).select("id", "status"), old, old.where("call_id % 2 = 1"))[0]


def _cascade(s, d):
    gone = V.calls(s, d).where("status = 'processing'").select("id")
    jobs = C.without(V.jobs(s, d), "call_id", gone, "id")
    voices = C.without(V.voice_prints(s, d), "call_id", gone, "id")
    calls = C.without(V.calls(s, d), "id", gone, "id")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return n(jobs, "jobs").unionByName(n(voices, "voice_prints")).unionByName(n(calls, "calls"))


def _voices(s, d):
    old = V.voice_prints(s, d).where("id % 3 <> 0").withColumn("embedding", F.slice("embedding", 1, 1))
    new = V.voice_prints(s, d).where("id % 3 <> 1").withColumn("embedding", F.array(F.lit(0.5)))
    return C.voice_prints_merged(old, new).select("call_id", "speaker_id", "name", F.round(F.element_at("embedding", 1), 5).alias("x"))


def _created(s, d):
    c = V.calls(s, d).select("id", "organization_id", "external_id")
    new = c.where("id % 4 = 0").select((F.col("id") + 1_000_000).alias("id"), "organization_id", F.expr("CASE WHEN id % 8 = 0 THEN external_id WHEN id % 12 = 0 THEN NULL ELSE concat('new-', id) END").alias("external_id"))
    return C.created(c, new)


def _stream_counts(s, d):
    return J.run_to_end(J.job_counts(J.events_stream(s, d), "40 days"), scratch(s), "complete").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _stream_segments(s, d):
    """Words from a file stream through the stateful segmenter; the newest row of each segment counts."""
    folder = scratch(s) + "/words"
    words = V.words(s, d).withColumn("ordinal", F.col("sequence") * 100_000 + F.col("pos")).select("call_id", "ordinal", "word", "speaker_id", "start_ms", "end_ms")
    # each call's words in order, as a recogniser sends them
    words.repartition("call_id").sortWithinPartitions("call_id", "ordinal").write.parquet(folder)
    with J.keyed_state(s):
        out = J.run_to_end(J.segments(s.readStream.schema(words.schema).parquet(folder)), scratch(s), "update")
    last = out.groupBy("call_id", "sequence").agg(F.max_by(F.struct("speaker_id", "start_ms", "end_ms", "n_words", "text"), "n_words").alias("x"))
    return last.select("call_id", "sequence", "x.*")


LEASE_HOURS = 6


def _stream_leases(s, d):
    """Events as signs of life of jobs' workers, through the stream of leases with its own clock."""
    kind = F.expr("CASE event_id % 4 WHEN 0 THEN 'lease' WHEN 2 THEN CASE event_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' ELSE 'heartbeat' END ELSE 'heartbeat' END")
    events = J.events_stream(s, d).select(F.col("user_id").alias("job_id"), kind.alias("kind"), F.expr("concat('w', event_id % 2)").alias("worker"), (F.col("event_id") % 3).alias("attempt"), F.col("ts").alias("at"))
    with J.keyed_state(s):
        out = J.run_to_end(leases.leases(events, LEASE_HOURS * 3600, event_time=True), scratch(s), "append")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS").alias(c)
    return out.select("job_id", "status", "worker", "attempt", stamp("at"), stamp("lock_ends"))


QUERIES = {
    "stream_leases": _stream_leases,
    "upsert_transcripts": _upsert,
    "toggle_favorite": lambda s, d: C.updated(V.calls(s, d), "id", 7, is_favorite=~F.col("is_favorite")).select("id", "is_favorite"),
    "commit_analysis": _analysis,
    "delete_cascade": _cascade,
    "upsert_voice_prints": _voices,
    "create_calls": _created,
    "stream_job_counts": _stream_counts,
    "stream_segments": _stream_segments,
}

_SEG = """s1 AS (SELECT *, CASE WHEN lag(speaker_id) OVER o = speaker_id AND start_ms <= lag(end_ms) OVER o + 1500 THEN 0 ELSE 1 END AS new FROM words WINDOW o AS (PARTITION BY call_id ORDER BY sequence, pos)),
s2 AS (SELECT *, (sum(new) OVER (PARTITION BY call_id ORDER BY sequence, pos ROWS UNBOUNDED PRECEDING))::BIGINT - 1 AS part FROM s1)"""

#: One event after the other for each job: (holder, its attempt, when its lock ends) before and after it.
_LEASES = f"""WITH RECURSIVE
e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seen, kind, worker) AS k FROM (
  SELECT user_id AS job_id, CASE event_id % 4 WHEN 0 THEN 'lease' WHEN 2 THEN CASE event_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' ELSE 'heartbeat' END ELSE 'heartbeat' END AS kind,
    'w' || (event_id % 2) AS worker, event_id % 3 AS attempt, ts AS seen, date_trunc('millisecond', ts) AS clock FROM events)),
n AS (
  SELECT job_id, 0::BIGINT AS k, NULL::VARCHAR AS kind, NULL::VARCHAR AS worker, NULL::BIGINT AS attempt, NULL::TIMESTAMP AS seen, NULL::TIMESTAMP AS over, NULL::VARCHAR AS h0, NULL::BIGINT AS a0, NULL::TIMESTAMP AS e0,
    NULL::VARCHAR AS h, NULL::BIGINT AS a, NULL::TIMESTAMP AS ends, NULL::VARCHAR AS status FROM (SELECT DISTINCT job_id FROM e)
  UNION ALL
  SELECT job_id, k, kind, worker, attempt, seen, over, h0, a0, e0,
    CASE WHEN status = 'running' THEN worker WHEN status = 'refused' AND over IS NULL THEN h0 END, CASE WHEN status = 'running' THEN coalesce(CASE WHEN over IS NULL THEN a0 END, attempt) WHEN status = 'refused' AND over IS NULL THEN a0 END,
    CASE WHEN status = 'running' THEN clock + INTERVAL {LEASE_HOURS} HOUR WHEN status = 'refused' AND over IS NULL THEN e0 END, status
  FROM (SELECT *, CASE WHEN (kind = 'lease' AND (h0 IS NULL OR over IS NOT NULL)) OR (kind = 'heartbeat' AND h0 = worker AND over IS NULL) THEN 'running' WHEN kind = 'complete' AND h0 = worker AND over IS NULL THEN 'completed' WHEN kind = 'fail' AND h0 = worker AND over IS NULL THEN 'failed' ELSE 'refused' END AS status
    FROM (SELECT e.*, n.h AS h0, n.a AS a0, n.ends AS e0, CASE WHEN n.ends <= e.clock THEN n.ends END AS over FROM n JOIN e ON e.job_id = n.job_id AND e.k = n.k + 1))),
r AS (
  SELECT job_id, status, worker, CASE WHEN status = 'refused' THEN attempt WHEN status = 'running' THEN a ELSE a0 END AS attempt, seen, CASE WHEN status = 'running' THEN ends END AS lock_ends FROM n WHERE k > 0
  UNION ALL SELECT job_id, 'pending', h0, a0, over, NULL FROM n WHERE over IS NOT NULL
  UNION ALL SELECT job_id, 'pending', h, a, ends, NULL FROM n WHERE h IS NOT NULL AND ends <= (SELECT max(clock) FROM e) AND k = (SELECT max(k) FROM e WHERE e.job_id = n.job_id))
SELECT job_id, status, worker, attempt, strftime(seen, '%Y-%m-%d %H:%M:%S.%g') AS "at", strftime(lock_ends, '%Y-%m-%d %H:%M:%S.%g') AS lock_ends FROM r"""

SQL = {
    "stream_leases": _LEASES,
    "upsert_transcripts": sql(V.TRANSCRIPTS, "n AS (SELECT call_id + 5 AS call_id FROM transcripts WHERE call_id % 3 = 0)", body="SELECT call_id, primary_language FROM transcripts WHERE call_id NOT IN (SELECT call_id FROM n) UNION ALL SELECT call_id, 'xx' FROM n"),
    "toggle_favorite": sql(V.CALLS, body="SELECT id, CASE WHEN id = 7 THEN NOT is_favorite ELSE is_favorite END AS is_favorite FROM calls"),
    "commit_analysis": sql(V.CALLS, V.ANALYSES, body="SELECT id, CASE WHEN id IN (SELECT call_id FROM analyses WHERE call_id % 2 = 1) THEN 'completed' ELSE status END AS status FROM calls"),
    "delete_cascade": sql(V.CALLS, V.JOBS, V.VOICE_PRINTS, "g AS (SELECT id FROM calls WHERE status = 'processing')", body="SELECT 'jobs' AS name, count(*) AS n FROM jobs WHERE call_id IS NULL OR call_id NOT IN (FROM g) UNION ALL SELECT 'voice_prints', count(*) FROM voice_prints WHERE call_id NOT IN (FROM g) UNION ALL SELECT 'calls', count(*) FROM calls WHERE id NOT IN (FROM g)"),
    "upsert_voice_prints": sql(V.VOICE_PRINTS, body="SELECT call_id, speaker_id, CASE WHEN id % 3 <> 0 THEN name END AS name, CASE WHEN id % 3 <> 1 THEN 0.5 ELSE round(embedding[1], 5) END AS x FROM voice_prints"),
    "create_calls": sql(V.CALLS, body="SELECT id + 1000000 AS id, organization_id, CASE WHEN id % 12 = 0 THEN NULL ELSE 'new-' || id END AS external_id FROM calls WHERE id % 4 = 0 AND id % 8 <> 0"),
    "stream_job_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_segments": sql(V.SEGMENTS, V.WORDS, _SEG, body="SELECT call_id, part AS sequence, any_value(speaker_id) AS speaker_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, string_agg(word, ' ' ORDER BY sequence, pos) AS text FROM s2 GROUP BY 1, 2"),
}
