"""A job's stages, what follows from them, and what needs no model."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import acoustics as K
from parlance.operators import calls as C
from parlance.operators import exports as X
from parlance.operators import signal as G
from parlance.operators import stages as S
from parlance.sources import views as V
from parlance.sources.views import NOW, sql

#: A moment inside the calls' dates, and the list page's date choices.
THEN, DATES = "2001-07-20 09:30:00", ("today", "7d", "30d", "90d")
KINDS = ["emotions", "view"]
CLASSIFIERS = [S.Classifier("Cancellation risk"), S.Classifier("Any complaint"), S.Classifier("Mood", "enum"), S.Classifier("Upsell"), S.Classifier("Old complaint", enabled=False)]

_PAYLOAD = "CASE event_id % 6 WHEN 0 THEN '{\"force_retranscribe\": true}' WHEN 1 THEN '{\"force_retranscribe\": \"true\"}' WHEN 2 THEN '{\"call_id\": \"' || event_id || '\"}' WHEN 3 THEN '{\"call_id\": \"x\"}' ELSE '{}' END"
_CALL = "CASE WHEN event_id % 6 NOT IN (2, 3) THEN user_id END"
_KIND = "CASE WHEN event_id % 4 < 2 THEN 'analyze_call' ELSE 'process_call' END"
_STORED = "CASE doc_id % 3 WHEN 0 THEN '{\"segments\": []}' WHEN 1 THEN '{\"segments\": [' END"


def _stages(s, d):
    jobs = V.table(s, d, "events").select(F.col("event_id").alias("id"), F.expr(_CALL).alias("call_id"), F.expr(_KIND).alias("kind"), F.expr(_PAYLOAD).alias("payload"))
    recordings = V.recordings(s, d).where("call_id % 5 <> 0")
    transcripts = V.table(s, d, "documents").select(F.col("doc_id").alias("call_id"), F.expr(_STORED).alias("transcript_json"))
    return S.next_stages(jobs, V.calls(s, d), recordings, transcripts)


def _dated(s, d):
    calls, transcripts = V.calls(s, d), V.transcripts(s, d)
    parts = [C.for_display(calls, transcripts, C.DisplayFilter(date=x), THEN).agg(F.lit(x).alias("date"), F.count("*").alias("n")) for x in DATES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _answers(s, d):
    """Answers for every second call; every third of these is no JSON."""
    text = F.expr("CASE WHEN call_id % 3 = 0 THEN 'sorry' ELSE concat('{\"title\": \"Call ', call_id, '\", \"summary\": \"ok ok ok ok\", \"resolved\": false, \"sentiment_score\": 0.5}') END")
    return V.segments(s, d).select("call_id").distinct().where("call_id % 2 = 1").select("call_id", text.alias("answer"))


def _short(s, d):
    """Segments, of which every fifth call has one word only."""
    rows = V.segments(s, d)
    return rows.where("call_id % 5 <> 0 OR sequence = 0").withColumn("raw_text", F.expr("CASE WHEN call_id % 5 = 0 THEN 'Hello' ELSE raw_text END"))


class FirstWords:
    """A model for tests: a window's first sixty characters."""

    def complete(self, prompt: str) -> str:
        return prompt[:60]


def _clustered(s, d):
    """Voice prints as windows of 800 ms every 400, forty to a call, whose regions are the tens of them."""
    div = lambda n: F.call_function("div", F.col("id"), F.lit(n).cast("bigint"))
    windows = V.voice_prints(s, d).select(div(40).alias("call_id"), "id", ((F.col("id") % 40) * 400).alias("window_start"), ((F.col("id") % 40) * 400 + 800).alias("window_end"), "embedding")
    regions = windows.groupBy("call_id", div(10).alias("region")).agg(F.min("window_start").alias("start_ms"), F.max("window_end").alias("end_ms"))
    hints = windows.select("call_id", F.when(F.col("call_id") % 4 != 0, F.col("call_id") % 4).alias("speakers")).distinct()
    return K.clustered_turns(regions.where("call_id % 5 <> 0 OR region % 4 = 0"), windows, hints)


QUERIES = {
    "clustered_turns": _clustered,
    "time_slices": lambda s, d: V.voice_prints(s, d).select("id", G.time_slice(F.col("embedding"), 4000, 2, F.col("id") % 7, F.col("id") % 5 + 2).alias("x"), G.duration_ms(F.col("embedding"), 2000, 2).alias("ms")).select("id", "ms", F.size("x").cast("bigint").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 5).alias("total")),
    "next_stages": _stages,
    "plugin_jobs": lambda s, d: S.plugin_jobs(V.calls(s, d).where("status = 'completed'"), V.jobs(s, d), KINDS, NOW).groupBy("call_id", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("new")),
    "classifiers": lambda s, d: S.classified(V.segments(s, d).select("call_id", F.expr("CASE sequence % 5 WHEN 0 THEN raw_text || ' I want to Cancel' WHEN 1 THEN raw_text || ' BAD service' ELSE raw_text END").alias("text")), CLASSIFIERS).groupBy("call_id", "classifier").agg(F.count_if("value").alias("n"), F.count("*").alias("asked")),
    "analysis_or_fallback": lambda s, d: S.analysed(_answers(s, d), _short(s, d), V.transcripts(s, d)),
    "compressed_prompts": lambda s, d: S.compressed(V.table(s, d, "documents").select(F.col("doc_id").alias("call_id"), "text"), 120, FirstWords()),
    "transcript_words": lambda s, d: X.words_of(X.with_words(V.segments(s, d), V.words(s, d))).withColumn("pos", F.col("pos").cast("bigint")),
    "call_list_dates": _dated,
    "turns_of_regions": lambda s, d: K.turns_of_regions(
        V.segments(s, d).select("call_id", F.col("sequence").alias("region"), "start_ms", "end_ms"), V.segments(s, d).where("sequence % 2 = 0").select("call_id", F.col("sequence").alias("region"), F.col("speaker_id").alias("label")),
        V.calls(s, d).where("duration_ms IS NOT NULL").select(F.col("id").alias("call_id"), "duration_ms")),
    "padded_chunks": lambda s, d: G.padded_chunks(V.voice_prints(s, d).select(F.col("id").alias("call_id"), "embedding"), "embedding", 24).select("call_id", F.col("chunk").cast("bigint").alias("chunk"), F.size("samples").cast("bigint").alias("n"), F.col("real").cast("bigint").alias("real"), F.round(F.element_at("samples", -1), 6).alias("last")),
}

_T = "CASE sequence % 5 WHEN 0 THEN raw_text || ' I want to Cancel' WHEN 1 THEN raw_text || ' BAD service' ELSE raw_text END"


def _flag(name: str) -> str:
    return " OR ".join(f"contains(lower(t), '{w}')" for w in T.FLAGS[name])


_ASKED = "SELECT call_id, '{0}' AS classifier, count(*) FILTER (WHERE {1}) AS n, count(*) AS asked FROM q GROUP BY 1"

SQL = {
    "time_slices": sql(V.VOICE_PRINTS, "b AS (SELECT id, embedding, len(embedding) AS m, id % 7 * 8 AS lo, (id % 5 + 2) * 8 AS hi FROM voice_prints)", "c AS (SELECT *, CASE WHEN lo < hi THEN embedding[least(lo, m) + 1:least(hi, m)] ELSE [] END AS x FROM b)", body="SELECT id, (m // 2 * 1000 // 2000)::BIGINT AS ms, len(x) AS n, round(coalesce(list_sum(x), 0), 5)::DOUBLE AS total FROM c"),
    "next_stages": sql(
        V.CALLS, V.RECORDINGS, f"j AS (SELECT event_id AS id, CASE WHEN event_id % 6 = 2 THEN event_id ELSE {_CALL} END AS call_id, {_KIND} AS kind, event_id % 6 = 0 AS forced FROM events)",
        "e AS (SELECT *, CASE WHEN call_id IS NULL THEN 'no call id' WHEN call_id NOT IN (SELECT id FROM calls) THEN 'call not found' WHEN call_id % 5 = 0 OR call_id NOT IN (SELECT call_id FROM recordings) THEN 'no recording' END AS error FROM j)",
        body="SELECT id, call_id, CASE WHEN error IS NOT NULL THEN 'failed' WHEN call_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) AND (kind = 'analyze_call' OR NOT forced) THEN 'analyze' ELSE 'transcribe' END AS stage, error FROM e"),
    "plugin_jobs": sql(V.CALLS, V.JOBS, "w AS (SELECT id AS call_id, unnest(['emotions', 'view']) AS kind FROM calls WHERE status = 'completed')", "a AS (SELECT call_id, kind, 0 AS new FROM jobs UNION ALL SELECT call_id, kind, 1 FROM w WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.call_id = w.call_id AND j.kind = w.kind))", body="SELECT call_id, kind, count(*) AS n, sum(new)::BIGINT AS new FROM a GROUP BY 1, 2"),
    "classifiers": sql(V.SEGMENTS, f"q AS (SELECT call_id, {_T} AS t FROM segments)", body=" UNION ALL ".join((_ASKED.format("Cancellation risk", _flag("cancellation")), _ASKED.format("Any complaint", _flag("complaint")), _ASKED.format("Upsell", "false")))),
    "analysis_or_fallback": sql(
        V.SEGMENTS, V.TRANSCRIPTS, "q AS (SELECT call_id, sequence, CASE WHEN call_id % 5 = 0 THEN 'Hello' ELSE trim(raw_text) END AS t FROM segments WHERE call_id % 5 <> 0 OR sequence = 0)",
        "n AS (SELECT call_id, sum(len(regexp_extract_all(t, '\\S+'))) >= 4 AND call_id % 2 = 1 AND call_id % 3 <> 0 AS m FROM q GROUP BY 1)",
        "b AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY call_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0) AS before FROM q WHERE t <> '')",
        "o AS (SELECT call_id, string_agg(t, ' ' ORDER BY sequence) AS t FROM b WHERE before < 280 GROUP BY 1)",
        body="SELECT n.call_id, m AS from_model, CASE WHEN m THEN 'Call ' || n.call_id WHEN primary_language = 'he' THEN 'שיחה מוקלטת' WHEN primary_language = 'ru' THEN 'Записанный разговор' ELSE 'Recorded conversation' END AS title, coalesce(CASE WHEN length(o.t) > 280 THEN left(o.t, 280) || '…' ELSE o.t END, '') AS summary, NOT m AS resolved, CASE WHEN m THEN 0.5 ELSE 0 END::DOUBLE AS sentiment_score FROM n LEFT JOIN o USING (call_id) LEFT JOIN transcripts t ON t.call_id = n.call_id"),
    "transcript_words": sql(V.SEGMENTS, V.WORDS, body="SELECT call_id, sequence, pos, word, start_ms, end_ms FROM words"),
    "call_list_dates": sql(V.CALLS, body=" UNION ALL ".join(f"SELECT '{k}' AS date, count(*) AS n FROM calls" + (f" WHERE created_at >= TIMESTAMP '2001-07-20' - to_days({C.DAYS[k]})" if k in C.DAYS else "") for k in DATES)),
    "turns_of_regions": sql(V.SEGMENTS, V.CALLS, body="SELECT call_id, CASE WHEN count(*) OVER (PARTITION BY call_id) > 1 AND sequence % 2 = 0 THEN speaker_id ELSE 0 END AS speaker_id, start_ms, end_ms FROM segments UNION ALL SELECT id, 0, 0, duration_ms FROM calls WHERE duration_ms IS NOT NULL AND id NOT IN (SELECT call_id FROM segments)"),
    "padded_chunks": sql(V.VOICE_PRINTS, "c AS (SELECT id AS call_id, embedding, unnest(range((len(embedding) + 23) // 24)) AS chunk FROM voice_prints)", body="SELECT call_id, chunk, 24::BIGINT AS n, least(24, len(embedding) - 24 * chunk)::BIGINT AS real, round(coalesce(embedding[24 * chunk + 24], 0), 6) AS last FROM c"),
}
