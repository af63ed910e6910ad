"""Text scalars, search, JSON and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import lenient as L
from parlance.functions import text as T
from parlance.operators import exports as X
from parlance.operators import ngrams
from parlance.operators import search as S
from parlance.sources import views as V
from parlance.sources.views import NOW, sql

COLUMNS = ("title", "transcript", "topics")
QUERY = "thanti erin*"


def _docs(s, d):
    return V.table(s, d, "documents")


def _whole(s, d):
    """The transcripts, with all of their text as the sample."""
    return _docs(s, d).select(F.col("doc_id").alias("call_id"), F.expr("CASE WHEN doc_id % 50 <> 0 THEN lang END").alias("primary_language"), F.coalesce("text", F.lit("")).alias("sample_text"))


def _sample(s, d):
    """Documents' texts with things to normalise."""
    d = _whole(s, d)
    t = F.expr("concat(sample_text, CASE call_id % 4 WHEN 0 THEN ' 20 dollars  and 0501234567' WHEN 1 THEN ' 5 NIS' WHEN 2 THEN ' 100 руб. ' ELSE '  ' END)")
    return d.select("call_id", "primary_language", t.alias("t"))


_SAMPLE = "sample AS (SELECT call_id, primary_language, sample_text || CASE call_id % 4 WHEN 0 THEN ' 20 dollars  and 0501234567' WHEN 1 THEN ' 5 NIS' WHEN 2 THEN ' 100 руб. ' ELSE '  ' END AS t FROM transcripts)"


def _replaced(c: str) -> str:
    for old, new in T.CURRENCIES:
        c = f"replace({c}, '{old}', '{new}')"
    return c


def _names(s, d):
    n = F.expr("CASE id % 5 WHEN 0 THEN concat('Call recording Ann B_240', lpad(id % 9 + 101, 3, '0'), '_1', lpad(id % 60, 2, '0'), '230.m4a') WHEN 1 THEN concat('Call +97250000', lpad(id, 4, '0'), '_240131_235959.wav') WHEN 2 THEN concat('note_', id, '.v2.mp3') WHEN 3 THEN concat('a_b_241301_101010.ogg') ELSE concat('Call 12', id % 10, '.aac') END")
    return V.calls(s, d).select("id", n.alias("name"))


_NAMES = "names AS (SELECT id, CASE id % 5 WHEN 0 THEN 'Call recording Ann B_240' || lpad((id % 9 + 101)::VARCHAR, 3, '0') || '_1' || lpad((id % 60)::VARCHAR, 2, '0') || '230.m4a' WHEN 1 THEN 'Call +97250000' || CASE WHEN id < 10000 THEN lpad(id::VARCHAR, 4, '0') ELSE left(id::VARCHAR, 4) END || '_240131_235959.wav' WHEN 2 THEN 'note_' || id || '.v2.mp3' WHEN 3 THEN 'a_b_241301_101010.ogg' ELSE 'Call 12' || (id % 10) || '.aac' END AS name FROM calls)"


def _parsed(s, d):
    p = _names(s, d).withColumn("p", T.parsed_filename(F.col("name")))
    return p.select("id", "name", "p.contact", "p.phone", F.date_format("p.started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), T.mime_of(F.col("name")).alias("mime"))


def _fold(c: str) -> str:
    return f"translate(lower({c}), '{S.MARKED}', '{S.PLAIN}')"


_TERMS = "d AS (SELECT call_id, " + ", ".join(f"regexp_extract_all({_fold(f'coalesce({c}, {chr(39) * 2})')}, '[\\p{{L}}\\p{{N}}]+') AS {c}_t" for c in COLUMNS) + " FROM search_documents)"
_BM25 = """c AS (SELECT call_id, len(title_t) + len(transcript_t) + len(topics_t) AS dl,
    len(list_filter(list_concat(list_concat(title_t, transcript_t), topics_t), lambda t: starts_with(t, 'thanti'))) AS tf0,
    len(list_filter(list_concat(list_concat(title_t, transcript_t), topics_t), lambda t: starts_with(t, 'erin'))) AS tf1 FROM d),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE tf0 > 0) AS df0, count(*) FILTER (WHERE tf1 > 0) AS df1 FROM c),
hits AS (SELECT call_id, round(ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) + ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)), 6) AS score FROM c, s WHERE tf0 > 0 OR tf1 > 0)"""
_WHO = "'Speaker ' || CASE speaker_role WHEN 'agent' THEN 1 WHEN 'customer' THEN 2 WHEN 'supervisor' THEN 3 ELSE speaker_id + 1 END"
_MMSS = "lpad(({0} // 60000)::VARCHAR, 2, '0') || ':' || lpad(({0} % 60000 // 1000)::VARCHAR, 2, '0')"


def _clock(c: str, mark: str) -> str:
    return f"lpad(({c} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({c} % 3600000 // 60000)::VARCHAR, 2, '0') || ':' || lpad(({c} % 60000 // 1000)::VARCHAR, 2, '0') || '{mark}' || lpad(({c} % 1000)::VARCHAR, 3, '0')"


def _json_values(s, d):
    raw = F.expr("CASE event_id % 8 WHEN 0 THEN '{\"v\": true}' WHEN 1 THEN '{\"v\": \"Yes\"}' WHEN 2 THEN '{\"v\": \"no\"}' WHEN 3 THEN '{\"v\": \"+0.75\"}' WHEN 4 THEN '{\"v\": 0}' WHEN 5 THEN '{\"v\": \"N/A\"}' WHEN 6 THEN '{\"v\": null}' ELSE props END")
    return V.table(s, d, "events").select(F.col("event_id").alias("id"), F.get_json_object(raw, "$.v").alias("v"), F.get_json_object("props", "$.k").alias("k"))


_VALUES = "vals AS (SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN 'Yes' WHEN 2 THEN 'no' WHEN 3 THEN '+0.75' WHEN 4 THEN '0' WHEN 5 THEN 'N/A' END AS v, json_extract_string(props, '$.k') AS k FROM events)"


def _events(s, d):
    rows = V.calls(s, d).select(F.col("id").alias("call_id"), F.concat(F.lit("Call\n"), "external_id").alias("title"), F.col("status").alias("summary"), F.expr("CASE WHEN id % 2 = 0 THEN 'Room 1' END").alias("location"), F.expr("CASE WHEN id % 3 = 0 THEN created_at END").alias("start"))
    return X.ics(rows, NOW)


QUERIES = {
    "normalize_text": lambda s, d: _sample(s, d).select("call_id", T.normalised(F.col("t")).alias("text")),
    "detect_direction": lambda s, d: _sample(s, d).select("call_id", T.direction(F.expr("CASE WHEN call_id % 10 = 0 THEN 'שלום עולם abc' ELSE t END"), F.expr("CASE WHEN call_id % 3 = 0 THEN primary_language END")).alias("direction")),
    "detect_script_language": lambda s, d: _sample(s, d).select("call_id", T.script_language(F.expr("CASE call_id % 10 WHEN 0 THEN 'שלום עולם' WHEN 1 THEN 'Привет мир' WHEN 2 THEN '12 34' WHEN 3 THEN 'مرحبا بالعالم' WHEN 4 THEN 'سلام چطوری' ELSE t END")).alias("language")),
    "ngram_language": lambda s, d: ngrams.detected(_docs(s, d).select("doc_id", "text"), "text", ngrams.profiles(_docs(s, d), "text", "lang")).select("doc_id", "language", "lead"),
    "agent_greeting": lambda s, d: V.segments(s, d).select("call_id", "sequence", T.is_greeting(F.expr("CASE WHEN sequence % 4 = 0 THEN concat('HOW CAN I HELP ', raw_text) ELSE raw_text END")).alias("greets")),
    "parse_filename": _parsed,
    "degenerate_text": lambda s, d: _docs(s, d).select("doc_id", T.is_degenerate(F.col("text")).alias("degenerate")),
    "foreign_script": lambda s, d: _docs(s, d).select("doc_id", T.has_foreign_script(F.expr("CASE WHEN doc_id % 5 = 0 THEN concat(text, ' 漢字漢字') ELSE text END")).alias("foreign")),
    "heuristic_summary": lambda s, d: V.transcripts(s, d).select("call_id", T.fallback_title(F.col("primary_language")).alias("title"), F.lit(True).alias("resolved"), F.lit(0.0).alias("sentiment_score")),
    "classifier_flags": lambda s, d: V.segments(s, d).withColumn("t", F.expr("CASE WHEN sequence % 5 = 0 THEN concat(raw_text, ' Please CANCEL it') WHEN sequence % 5 = 1 THEN concat(raw_text, ' bad service') ELSE raw_text END")).select("call_id", "sequence", T.flag("cancellation", F.col("t")).alias("cancellation"), T.flag("complaint", F.col("t")).alias("complaint")),
    "vocabulary": lambda s, d: _docs(s, d).select("doc_id", F.md5(T.vocabulary(F.col("text"), {"the ": "THE ", "er": "ER", "THE ER": "x"})).alias("digest")),
    "display_strings": lambda s, d: V.segments(s, d).select("call_id", "sequence", T.speaker_label(F.col("speaker_role"), F.col("speaker_id")).alias("label"), T.mm_ss(F.col("start_ms")).alias("at"), T.clock(F.col("end_ms"), ",").alias("end"), T.age(F.floor(F.col("end_ms") / 10)).alias("age")),
    "html_strings": lambda s, d: _whole(s, d).select("call_id", T.highlighted(F.concat(F.lit("<a> & "), "sample_text"), "The").alias("html"), T.percent_encoded(F.concat(F.lit("a b*c~d/"), F.col("call_id").cast("string"))).alias("encoded")),
    "token_estimate": lambda s, d: _docs(s, d).select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens")),
    "normal_names": lambda s, d: _docs(s, d).select("doc_id", T.language_code(F.expr("CASE doc_id % 6 WHEN 0 THEN 'Hebrew' WHEN 1 THEN 'RUS' WHEN 2 THEN 'und' WHEN 3 THEN NULL ELSE lang END")).alias("lang"), T.status_name(F.expr("CASE WHEN doc_id % 2 = 0 THEN 'Completed' ELSE 'odd' END")).alias("status"), T.role_name(F.expr("CASE WHEN doc_id % 2 = 0 THEN 'AGENT' ELSE source END")).alias("role")),
    "fts_postings": lambda s, d: S.postings(V.search_documents(s, d), COLUMNS),
    "fts_match": lambda s, d: S.matches(V.search_documents(s, d), QUERY, COLUMNS),
    "fts_rank_bm25": lambda s, d: S.bm25(V.search_documents(s, d), QUERY, COLUMNS).withColumn("score", F.round("score", 6)),
    "fts_snippet": lambda s, d: V.search_documents(s, d).select("call_id", S.snippet(F.col("transcript"), "thanti", 4).alias("snippet")).where("snippet IS NOT NULL AND snippet <> ''"),
    "search_filtered": lambda s, d: S.searched(V.search_documents(s, d), V.calls(s, d), QUERY, COLUMNS, (F.col("status") == "completed") & (F.col("direction") != "unknown"), 20).select("call_id", "score", "external_id"),
    "ask_context": lambda s, d: S.ask_context(V.search_documents(s, d), QUERY, COLUMNS, 5),
    "ask_citations": lambda s, d: S.cited(S.ask_context(V.search_documents(s, d), QUERY, COLUMNS, 5), [0, 2, 9]).select("source", "call_id"),
    "ask_citations_ordered": lambda s, d: S.cited(S.ask_context(V.search_documents(s, d), QUERY, COLUMNS, 5), [9, 2, 0, 2]).select("place", "source", "call_id"),
    "ask_citations_unknown": lambda s, d: S.cited(S.ask_context(V.search_documents(s, d), QUERY, COLUMNS, 5), [9, 70]).select("place", "source", "call_id"),
    "transcript_json_path": lambda s, d: V.transcripts(s, d).select("call_id", L.primary_language(F.col("transcript_json")).alias("language"), L.first_text(F.col("transcript_json")).alias("text")),
    "lenient_bool": lambda s, d: _json_values(s, d).select("id", L.boolean(F.col("v")).cast("string").alias("b"), L.boolean(F.col("k")).cast("string").alias("kb")),
    "lenient_number": lambda s, d: _json_values(s, d).select("id", L.number(F.col("v")).alias("n"), L.number(F.col("k")).alias("kn")),
    "lenient_text": lambda s, d: _json_values(s, d).select("id", L.text_or_null(F.col("v")).alias("t")),
    "job_payload": lambda s, d: V.table(s, d, "events").select(F.col("event_id").alias("id"), L.payload_options(F.expr("concat('{\"language_hint\": \"', event_type, '\", \"expected_speakers\": ', event_id % 15, ', \"force_retranscribe\": \"', CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END, '\"}')")).alias("p")).select("id", "p.*"),
    "export_srt": lambda s, d: X.srt(V.segments(s, d)),
    "export_vtt": lambda s, d: X.vtt(V.segments(s, d)),
    "export_txt": lambda s, d: X.txt(V.segments(s, d)),
    "export_markdown": lambda s, d: X.markdown(V.segments(s, d)),
    "export_full_text": lambda s, d: X.full_text(V.segments(s, d)),
    "export_json": lambda s, d: X.nested(V.segments(s, d)),
    "export_rttm": lambda s, d: X.rttm(V.turns(s, d)),
    "export_ics": _events,
    "rttm_parse": lambda s, d: X.parsed_rttm(X.rttm(V.turns(s, d))),
    "web_hook_payload": lambda s, d: X.web_hook(V.calls(s, d), V.analyses(s, d)).select("id", F.get_json_object("payload", "$.title").alias("title"), F.get_json_object("payload", "$.resolved").alias("resolved")),
}

_HI = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_CASES = "CASE WHEN lower(trim({0})) IN ('true','yes','y','1','да','כן') THEN true WHEN lower(trim({0})) IN ('false','no','n','0','нет','לא') THEN false WHEN TRY_CAST(trim({0}) AS DOUBLE) IS NOT NULL THEN TRY_CAST(trim({0}) AS DOUBLE) <> 0 END"
_GREET = " OR ".join(f"contains(lower(t), '{g}')" for g in T.GREETINGS)


def _flag(name: str) -> str:
    return " OR ".join(f"contains(lower(t), '{w}')" for w in T.FLAGS[name])


SQL = {
    "normalize_text": sql(V.TRANSCRIPTS, _SAMPLE, "q AS (SELECT call_id, array_to_string(regexp_extract_all(t, '\\S+'), ' ') AS t FROM sample)", "c AS (SELECT call_id, regexp_extract_all(" + _replaced("t") + ", '\\S+') AS w FROM q)", body="SELECT call_id, array_to_string(list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '05[0-9]{8}') THEN x[1:3] || '-' || x[4:6] || '-' || x[7:10] ELSE x END), ' ') AS text FROM c"),
    "detect_direction": sql(V.TRANSCRIPTS, _SAMPLE, body="SELECT call_id, CASE WHEN call_id % 3 = 0 AND primary_language IN ('en', 'ru') THEN 'ltr' WHEN call_id % 10 = 0 THEN 'rtl' ELSE 'ltr' END AS direction FROM sample"),
    "detect_script_language": sql(V.TRANSCRIPTS, _SAMPLE, body="SELECT call_id, CASE call_id % 10 WHEN 0 THEN 'he' WHEN 1 THEN 'ru' WHEN 2 THEN 'unknown' WHEN 3 THEN 'ar' WHEN 4 THEN 'he' ELSE CASE WHEN len(regexp_extract_all(t, '[Ѐ-ԯ]')) > len(regexp_extract_all(t, '[A-Za-z]')) THEN 'ru' WHEN regexp_matches(t, '[A-Za-z]') THEN 'en' ELSE 'unknown' END END AS language FROM sample"),
    "agent_greeting": sql(V.SEGMENTS, "q AS (SELECT call_id, sequence, CASE WHEN sequence % 4 = 0 THEN 'HOW CAN I HELP ' || raw_text ELSE raw_text END AS t FROM segments)", body=f"SELECT call_id, sequence, {_GREET} AS greets FROM q"),
    "parse_filename": sql(V.CALLS, _NAMES, body="SELECT id, name, CASE id % 5 WHEN 0 THEN 'Ann B' WHEN 2 THEN 'note_' || id || '.v2' WHEN 3 THEN 'a_b_241301_101010' END AS contact, CASE id % 5 WHEN 1 THEN '+97250000' || CASE WHEN id < 10000 THEN lpad(id::VARCHAR, 4, '0') ELSE left(id::VARCHAR, 4) END WHEN 4 THEN '12' || (id % 10) END AS phone, CASE id % 5 WHEN 0 THEN '2024-01-0' || (id % 9 + 1) || ' 1' || substr(lpad((id % 60)::VARCHAR, 2, '0'), 1, 1) || ':' || substr(lpad((id % 60)::VARCHAR, 2, '0'), 2, 1) || '2:30' WHEN 1 THEN '2024-01-31 23:59:59' END AS started_at, CASE id % 5 WHEN 0 THEN 'audio/mp4' WHEN 1 THEN 'audio/wav' WHEN 2 THEN 'audio/mpeg' WHEN 3 THEN 'audio/ogg' ELSE 'audio/aac' END AS mime FROM names"),
    "degenerate_text": r"WITH w AS (SELECT doc_id, regexp_extract_all(string_split(text, chr(10))[-1], '\S+') AS w FROM documents) SELECT doc_id, len(w) >= 4 AND 3 * len(list_distinct(list_transform(w, lambda x: lower(regexp_replace(x, '^[^\p{L}\p{M}\p{Nd}]+|[^\p{L}\p{M}\p{Nd}]+$', '', 'g'))))) <= len(w) AS degenerate FROM w",
    "foreign_script": "SELECT doc_id, doc_id % 5 = 0 AND 4 > 0.02 * (4 + len(regexp_extract_all(string_split(text, chr(10))[1], '\\p{L}'))) AS \"foreign\" FROM documents",
    "heuristic_summary": sql(V.TRANSCRIPTS, body="SELECT call_id, CASE primary_language WHEN 'he' THEN 'שיחה מוקלטת' WHEN 'ru' THEN 'Записанный разговор' ELSE 'Recorded conversation' END AS title, true AS resolved, 0.0::DOUBLE AS sentiment_score FROM transcripts"),
    "classifier_flags": sql(V.SEGMENTS, "q AS (SELECT call_id, sequence, CASE sequence % 5 WHEN 0 THEN raw_text || ' Please CANCEL it' WHEN 1 THEN raw_text || ' bad service' ELSE raw_text END AS t FROM segments)", body=f"SELECT call_id, sequence, {_flag('cancellation')} AS cancellation, {_flag('complaint')} AS complaint FROM q"),
    "vocabulary": "SELECT doc_id, md5(replace(replace(replace(text, 'the ', 'THE '), 'er', 'ER'), 'THE ER', 'x')) AS digest FROM documents",
    "display_strings": sql(V.SEGMENTS, "q AS (SELECT *, end_ms // 10 AS a FROM segments)", body=f"SELECT call_id, sequence, {_WHO} AS label, {_MMSS.format('start_ms')} AS at, {_clock('end_ms', ',')} AS \"end\", CASE WHEN a < 3600 THEN (a // 60) || 'm' WHEN a < 86400 THEN (a // 3600) || 'h' ELSE (a // 86400) || 'd' END AS age FROM q"),
    "html_strings": sql(V.TRANSCRIPTS, "q AS (SELECT call_id, '<a> & ' || left(sample_text, 60) AS t FROM transcripts)", "r AS (SELECT *, strpos(lower(t), 'the') AS p FROM q)", body=f"SELECT call_id, CASE WHEN p > 0 THEN {_HI.format('left(t, p - 1)')} || '<mark>' || substr(t, p, 3) || '</mark>' || {_HI.format('substr(t, p + 3)')} ELSE {_HI.format('t')} END AS html, 'a%20b%2Ac~d%2F' || call_id AS encoded FROM r"),
    "token_estimate": "SELECT doc_id, ceil(length(text) / 3)::BIGINT AS tokens FROM documents",
    "normal_names": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'he' WHEN 1 THEN 'ru' WHEN 2 THEN 'unknown' WHEN 3 THEN 'unknown' ELSE lang END AS lang, CASE WHEN doc_id % 2 = 0 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN doc_id % 2 = 0 THEN 'agent' ELSE 'unknown' END AS role FROM documents",
    "fts_postings": sql(V.SEARCH, _TERMS, "u AS (SELECT call_id, 'title' AS \"column\", unnest(title_t) AS term, unnest(range(len(title_t))) AS pos FROM d UNION ALL SELECT call_id, 'transcript', unnest(transcript_t), unnest(range(len(transcript_t))) FROM d UNION ALL SELECT call_id, 'topics', unnest(topics_t), unnest(range(len(topics_t))) FROM d)", body='SELECT "column", term, count(DISTINCT call_id) AS df, count(*) AS tf, min(pos) AS first_pos FROM u GROUP BY 1, 2 HAVING count(DISTINCT call_id) >= 20'),
    "fts_match": sql(V.SEARCH, _TERMS, body="SELECT call_id FROM d WHERE len(list_filter(list_concat(list_concat(title_t, transcript_t), topics_t), lambda t: starts_with(t, 'thanti') OR starts_with(t, 'erin'))) > 0"),
    "fts_rank_bm25": sql(V.SEARCH, _TERMS, _BM25, body="SELECT * FROM hits"),
    "search_filtered": sql(V.SEARCH, V.CALLS, _TERMS, _BM25, body="SELECT call_id, score, external_id FROM hits JOIN calls ON id = call_id WHERE status = 'completed' AND direction <> 'unknown' ORDER BY score DESC, created_at DESC, call_id LIMIT 20"),
    "ask_context": sql(V.SEARCH, _TERMS, _BM25, body="SELECT row_number() OVER (ORDER BY score DESC, call_id) AS source, call_id, title, score FROM hits JOIN search_documents USING (call_id) ORDER BY score DESC, call_id LIMIT 5"),
    "ask_citations": sql(V.SEARCH, _TERMS, _BM25, "a AS (SELECT row_number() OVER (ORDER BY score DESC, call_id) AS source, call_id FROM hits)", body="SELECT * FROM a WHERE source IN (1, 2)"),
    "ask_citations_ordered": sql(V.SEARCH, _TERMS, _BM25, "a AS (SELECT row_number() OVER (ORDER BY score DESC, call_id) AS source, call_id FROM hits)", body="SELECT CASE source WHEN 2 THEN 2 ELSE 3 END AS place, source, call_id FROM a WHERE source IN (1, 2)"),
    "ask_citations_unknown": sql(V.SEARCH, _TERMS, _BM25, "a AS (SELECT row_number() OVER (ORDER BY score DESC, call_id) AS source, call_id FROM hits)", body="SELECT source AS place, source, call_id FROM a WHERE source <= 5"),
    "transcript_json_path": sql(V.TRANSCRIPTS, body="SELECT call_id, lower(primary_language) AS language, sample_text AS text FROM transcripts"),
    "lenient_bool": sql(_VALUES, body=f"SELECT id, ({_CASES.format('v')})::VARCHAR AS b, ({_CASES.format('k')})::VARCHAR AS kb FROM vals"),
    "lenient_number": sql(_VALUES, body="SELECT id, TRY_CAST(regexp_replace(trim(v), '^\\++', '') AS DOUBLE) AS n, TRY_CAST(regexp_replace(trim(k), '^\\++', '') AS DOUBLE) AS kn FROM vals"),
    "lenient_text": sql(_VALUES, body="SELECT id, CASE WHEN trim(v) <> '' AND lower(trim(v)) NOT IN ('null','none','nil','n/a','na','undefined','unknown','-') THEN trim(v) END AS t FROM vals"),
    "job_payload": "SELECT event_id AS id, event_type AS language_hint, least(greatest(event_id % 15, 1), 10)::INT AS expected_speakers, event_id % 2 = 0 AS force_retranscribe FROM events",
    "export_srt": sql(V.SEGMENTS, "q AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY sequence) AS k FROM segments)", body=f"SELECT call_id, string_agg(k || chr(10) || {_clock('start_ms', ',')} || ' --> ' || {_clock('end_ms', ',')} || chr(10) || '[' || {_WHO} || '] ' || raw_text || chr(10) || chr(10), '' ORDER BY sequence) AS srt FROM q GROUP BY 1"),
    "export_vtt": sql(V.SEGMENTS, "q AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY sequence) AS k FROM segments)", body=f"SELECT call_id, 'WEBVTT - Transcript' || chr(10) || chr(10) || string_agg(k || chr(10) || {_clock('start_ms', '.')} || ' --> ' || {_clock('end_ms', '.')} || chr(10) || '<v ' || {_WHO} || '>' || raw_text || chr(10) || chr(10), '' ORDER BY sequence) AS vtt FROM q GROUP BY 1"),
    "export_txt": sql(V.SEGMENTS, body=f"SELECT call_id, string_agg('[' || {_MMSS.format('start_ms')} || '] ' || {_WHO} || ': ' || raw_text || chr(10), '' ORDER BY sequence) AS txt FROM segments GROUP BY 1"),
    "export_markdown": sql(V.SEGMENTS, f"q AS (SELECT call_id, max(end_ms) AS e, count(*) AS n, string_agg('- **[' || {_MMSS.format('start_ms')} || '] ' || {_WHO} || '**: ' || raw_text || chr(10), '' ORDER BY sequence) AS b FROM segments GROUP BY 1)", body=f"SELECT call_id, '# Conversation Transcript' || chr(10) || chr(10) || '- **Duration:** ' || {_MMSS.format('e')} || chr(10) || '- **Total Segments:** ' || n || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10) || b AS markdown FROM q"),
    "export_full_text": sql(V.SEGMENTS, body="SELECT call_id, string_agg(speaker_role || ': ' || raw_text, chr(10) ORDER BY sequence) AS full_text FROM segments GROUP BY 1"),
    "export_rttm": sql(V.SEGMENTS, V.TURNS, body="SELECT call_id, turn, printf('SPEAKER %d 1 %.3f %.3f <NA> <NA> speaker_%d <NA> <NA>', call_id, start_ms / 1000.0, (end_ms - start_ms) / 1000.0, speaker_id) AS line FROM turns"),
    "export_ics": sql(V.CALLS, "q AS (SELECT *, CASE WHEN id % 3 = 0 THEN created_at ELSE TIMESTAMP '2024-02-02' END AS s, chr(13) || chr(10) AS nl FROM calls WHERE id < 200)", body="SELECT id AS call_id, 'BEGIN:VCALENDAR' || nl || 'VERSION:2.0' || nl || 'PRODID:-//parlance//EN' || nl || 'CALSCALE:GREGORIAN' || nl || 'METHOD:PUBLISH' || nl || 'BEGIN:VEVENT' || nl || 'UID:' || id || '@calls.example' || nl || 'DTSTAMP:20240201T000000Z' || nl || 'DTSTART:' || strftime(s, '%Y%m%dT%H%M%SZ') || nl || 'DTEND:' || strftime(s + INTERVAL 1 HOUR, '%Y%m%dT%H%M%SZ') || nl || 'SUMMARY:Call ' || external_id || nl || 'DESCRIPTION:' || status || nl || CASE WHEN id % 2 = 0 THEN 'LOCATION:Room 1' || nl ELSE '' END || 'STATUS:CONFIRMED' || nl || 'END:VEVENT' || nl || 'END:VCALENDAR' || nl AS ics FROM q"),
    "rttm_parse": sql(V.SEGMENTS, V.TURNS, body="SELECT call_id::VARCHAR AS uri, 'speaker_' || speaker_id AS speaker, start_ms, end_ms FROM turns"),
    "web_hook_payload": sql(V.CALLS, V.ANALYSES, body="SELECT id, title, CASE WHEN resolved THEN 'true' ELSE 'false' END AS resolved FROM calls JOIN analyses ON call_id = id"),
}
_FIRST, _TEXT = "string_split(coalesce(text, ''), chr(10))[1]", "coalesce(text, '')"
_IS_HIT = "starts_with(regexp_extract(" + _fold("x") + ", '[\\p{L}\\p{N}]+'), 'thanti')"
SQL |= {
    "export_json": sql(V.SEGMENTS, body="SELECT call_id, to_json(list({'sequence': sequence, 'speaker_id': speaker_id, 'speaker_role': speaker_role, 'start_ms': start_ms, 'end_ms': end_ms, 'text': raw_text} ORDER BY sequence))::VARCHAR AS json FROM segments GROUP BY 1"),
    "fts_snippet": sql(V.SEARCH, "q AS (SELECT call_id, regexp_extract_all(transcript, '\\S+') AS w FROM search_documents)", f"h AS (SELECT call_id, w, greatest(coalesce(list_position(list_transform(w, lambda x: {_IS_HIT}), true), 0) - 4, 1) AS b FROM q)", f"s AS (SELECT call_id, array_to_string(list_transform(w[b:b + 7], lambda x: CASE WHEN {_IS_HIT} THEN '<b>' || x || '</b>' ELSE x END), ' ') AS snippet FROM h)", body="SELECT * FROM s WHERE snippet <> ''"),
}
#: The queries read whole texts: their SQL over the model's first lines, with all of the text instead.
SQL |= {
    "export_ics": SQL["export_ics"].replace(" WHERE id < 200", ""),
    "fts_postings": SQL["fts_postings"].replace('SELECT "column", term, count(DISTINCT call_id) AS df, count(*)', 'SELECT call_id, "column", term, count(*)').replace("GROUP BY 1, 2 HAVING count(DISTINCT call_id) >= 20", "GROUP BY 1, 2, 3"),
    "degenerate_text": SQL["degenerate_text"].replace("string_split(text, chr(10))[-1]", "text"),
    "foreign_script": SQL["foreign_script"].replace("string_split(text, chr(10))[1]", "text"),
    "html_strings": SQL["html_strings"].replace(_FIRST, _TEXT).replace("left(sample_text, 60)", "sample_text"),
    **{name: SQL[name].replace(_FIRST, _TEXT) for name in ("normalize_text", "detect_direction", "detect_script_language")},
}
