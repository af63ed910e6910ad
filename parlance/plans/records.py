"""Single records, users' writes, the kept index, and what models answered."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import answers as A
from parlance.functions import lenient as L
from parlance.functions import text as T
from parlance.functions import vectors
from parlance.operators import acoustics as K
from parlance.operators import index as I
from parlance.operators import plugins, queue
from parlance.operators import records as R
from parlance.operators.search import MARKED, PLAIN
from parlance.sources import views as V
from parlance.sources.scratch import scratch
from parlance.sources.views import NOW, sql

STAMP = "yyyy-MM-dd HH:mm:ss"
QUERY = "thanti cafe place7"


def _stamped(s, d):
    """Calls as a store keeps them: with tags and the time of their last change."""
    return V.calls(s, d).select("id", "status", F.lit("[]").alias("tags"), F.col("created_at").alias("updated_at"))


def _index(s, d):
    return I.built(I.entries(V.index_rows(s, d)))


def _saved(s, d):
    return _index(s, d).saved(f"{scratch(s)}/index")


def _stored_results(s, d):
    """All calls' plug-in results as a table, sorted by call: a call's results are a pruned scan."""
    folder = f"{scratch(s)}/results"
    plugins.run_plugins(V.table(s, d, "documents").select(F.col("doc_id").alias("call_id"), "text")).repartitionByRange("call_id").sortWithinPartitions("call_id", "plugin").write.parquet(folder)
    return s.read.parquet(folder)


def _totals(index):
    """An index by column: entries' words, terms and a checksum of them."""
    p = index.postings.groupBy("column").agg(F.count("*").alias("postings"), F.sum("tf").alias("tf"), F.sum(F.length("term")).alias("letters"))
    return index.lengths.groupBy("column").agg(F.count("*").alias("entries"), F.sum("n").alias("words")).join(p, "column")


def _analysis_json(s, d):
    a = V.analyses(s, d)
    return a.select("call_id", "title", F.to_json(F.struct("customer_intent", "resolved")).alias("analysis_json"))


def _commit(s, d):
    old = V.analyses(s, d).select("call_id", "title")
    new = old.where("call_id % 2 = 1").select("call_id", F.lit("again").alias("title"))
    calls, analyses = R.commit_analyses(V.calls(s, d).select("id", "status"), old, new)
    return calls.join(analyses.withColumnRenamed("call_id", "id"), "id", "left")


def _audio(s, d):
    calls = V.calls(s, d).select("id", "duration_ms", F.lit(None).cast("int").alias("channels"), F.lit(None).cast("int").alias("sample_rate"))
    recordings = V.recordings(s, d).select("id", "call_id", "duration_ms")
    measured = calls.where("id % 4 = 1").select(F.col("id").alias("call_id"), (F.col("id") * 10).alias("duration_ms"), F.lit(2).alias("channels"), F.lit(8000).alias("sample_rate"))
    c, r = R.set_audio_metadata(calls, recordings, measured)
    return c.select(F.lit("call").alias("kind"), "id", "duration_ms", "channels").unionByName(r.select(F.lit("recording").alias("kind"), "id", "duration_ms", F.lit(None).cast("int").alias("channels")))


def _plugin_rows(s, d):
    t = V.table(s, d, "events")
    rows = t.select(F.col("user_id").alias("call_id"), F.col("event_type").alias("plugin"), F.col("event_id").cast("string").alias("payload"), F.col("ts").alias("created_at"))
    old = rows.where("payload % 2 = 0")
    return R.save_plugin_results(old.groupBy("call_id", "plugin").agg(F.max("payload").alias("payload"), F.max("created_at").alias("created_at")), rows.where("payload % 2 = 1"))


def _transcripts(s, d):
    stored = F.expr("concat('{\"segments\":[{\"sequence\":0,\"speaker_id\":', doc_id % 3, ',\"text\":\"a\"},{\"sequence\":1,\"speaker_id\":1,\"speaker_label\":\"x\",\"text\":\"b\"}]}')")
    j = F.when(F.col("doc_id") % 7 != 0, stored).otherwise("[1]")
    return V.table(s, d, "documents").select(F.col("doc_id").alias("call_id"), j.alias("transcript_json"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"), F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))


def _answers(s, d):
    """Model answers of eight shapes, one for each document in turn."""
    shapes = (
        '{"title":"Conversation","summary":"ok ok ok ok","topics":["a",1,"b"],"key_facts":{"y":"two","x":"one"},"action_items":["call back","none",""],"entities":{"k":{"type":"place","name":"Rome"}},"scorecard":{"total_score":80,"rules":[{"name":"greets","score":5}]},"compliance":[{"name":"consent","passed":false},{}]}',
        '{"title":"Late parcel","summary":"The parcel is late.","topics":"one","key_facts":["f1",null],"action_items":{"b":{"task":"send","who":"Agent"},"a":{"text":"wait","owner":"someone"}},"entities":["x","NONE"],"scorecard":{"rules":[]}}',
        '{"title":null,"topics":{"b":"two","a":"one"},"action_items":[{"description":"check","assignee":"customer","deadline":"today"},{"text":"None"},5],"entities":[{"entity_type":"phone","value":"12"},{"value":""}],"compliance":"no"}',
        "no json",
    )
    answer = F.lit(shapes[-1])
    for k, text in enumerate(shapes[:-1]):
        answer = F.when(F.col("doc_id") % 4 == k, text).otherwise(answer)
    return V.table(s, d, "documents").select(F.col("doc_id").alias("call_id"), answer.alias("answer"))


def _coerced(s, d):
    rows, v = _answers(s, d), A.parsed(F.col("answer"))
    items = F.array_join(F.transform(A.action_items(v), lambda i: F.concat_ws("/", i["text"], F.coalesce(i["owner"], F.lit("-")), F.coalesce(i["deadline"], F.lit("-")))), "; ")
    ents = F.array_join(F.transform(A.entities(v), lambda e: F.concat_ws("=", e["entity_type"], e["value"])), "; ")
    card = A.scorecard(v)
    checks = F.array_join(F.transform(A.compliance(v), lambda c: F.concat_ws("=", c["rule"], c["passed"].cast("string"))), "; ")
    text = lambda path: A.string(F.try_variant_get(v, path, "variant"))
    return rows.select(
        "call_id", A.accepted_title(text("$.title"), F.lit("Recorded conversation")).alias("title"), A.accepted_summary(text("$.summary"), F.lit("opening")).alias("summary"),
        F.array_join(A.strings(v, "$.topics"), ",").alias("topics"), F.array_join(A.strings(v, "$.key_facts"), ",").alias("facts"), items.alias("items"), ents.alias("entities"),
        card["total_score"].alias("score"), F.array_join(F.transform(card["rules"], lambda r: F.concat_ws("/", r["rule"], r["score"].cast("string"), r["most"].cast("string"))), ",").alias("rules"), checks.alias("checks"),
    )


def _scored(s, d):
    """Answers whose scores, checks and evidence are the documents' own numbers, whole, quoted, fractional or negative."""
    n = "CASE doc_id % 4 WHEN 0 THEN CAST({0} AS STRING) WHEN 1 THEN concat('\"', {0}, '\"') WHEN 2 THEN concat({0}, '.5') ELSE concat('-', {0}) END"
    said = "CASE doc_id % 3 WHEN 0 THEN 'false' WHEN 1 THEN '\"false\"' ELSE '0' END"
    text = F.expr(
        "concat('{\"scorecard\":{\"total_score\":', CASE WHEN doc_id % 5 = 0 THEN " + n.format("n_chars") + " ELSE CAST(n_chars AS STRING) END, ',\"rules\":[{\"rule_name\":\"', source, '\",\"score\":', " + n.format("doc_id") + ", ',\"score_awarded\":7,\"explanation\":\"', lang, '\"}]},"
        "\"compliance\":[{\"name\":\"', lang, '\",\"passed\":', " + said + ", '}],\"action_items\":[{\"task\":\"', source, '\",\"evidence_segments\":[', doc_id % 9, ',', " + n.format("doc_id % 7") + ", ']}],"
        "\"topics\":', CASE doc_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN concat('[1,\"', lang, '\"]') WHEN 2 THEN concat('{\"a\":\"', source, '\"}') ELSE '7' END, ',\"resolved\":\"', CASE WHEN doc_id % 2 = 0 THEN 'no' ELSE '?' END, '\",\"sentiment_score\":\"', doc_id % 10, '\",\"reason\":', CASE WHEN doc_id % 2 = 0 THEN concat('[\"', lang, '\",null,', doc_id, ']') ELSE 'null' END, '}')"
    )
    rows = V.table(s, d, "documents").select(F.col("doc_id").alias("call_id"), text.alias("answer"))
    v = A.parsed(F.col("answer"))
    card, check, item = A.scorecard(v), A.compliance(v)[0], A.action_items(v)[0]
    return rows.select(
        "call_id", card["total_score"].alias("total"), card["rules"][0]["rule"].alias("rule"), card["rules"][0]["score"].alias("score"), card["rules"][0]["explanation"].alias("explanation"),
        check["rule"].alias("check_name"), check["passed"].alias("passed"), F.array_join(item["evidence"].cast("array<string>"), ",").alias("evidence"),
        F.array_join(A.topics(v, F.array(F.lit("heuristic"))), ",").alias("topics"), A.resolved(F.col("answer")).alias("resolved"), A.sentiment(F.col("answer")).alias("sentiment"), A.told(F.col("answer"), "reason", F.lit("unsaid")).alias("reason"),
    )


QUERIES = {
    "recording_by_call": lambda s, d: R.recording_of(V.recordings(s, d), 7),
    "analysis_by_call": lambda s, d: _analysis_json(s, d).where("call_id = 9").select("call_id", "title", F.get_json_object("analysis_json", "$.resolved").alias("resolved")),
    "organization_name": lambda s, d: V.table(s, d, "region").where("r_regionkey = 2").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name")),
    "job_lookup": lambda s, d: V.jobs(s, d).where("id = 11").select("id", "call_id", "kind", "status", "attempt"),
    "plugin_results_of_call": lambda s, d: _stored_results(s, d).where("call_id = 9").select("plugin", F.get_json_object("payload", "$.words").cast("bigint").alias("words")).orderBy("plugin"),
    "speakers_of_call": lambda s, d: V.voice_prints(s, d).where("call_id = 5").withColumn("blob", vectors.encoded(F.col("embedding"))).select("speaker_id", "name", F.octet_length("blob").cast("bigint").alias("bytes"), F.round(vectors.decoded(F.col("blob"))[0], 4).alias("x")).orderBy("speaker_id"),
    "update_status": lambda s, d: R.set_status(_stamped(s, d), 7, "failed", NOW).select("id", "status", F.date_format("updated_at", STAMP).alias("updated_at")),
    "replace_tags": lambda s, d: R.set_tags(_stamped(s, d), 7, ["vip", 'a "b"']).select("id", "tags", F.size(R.tags_of(F.col("tags"))).alias("n")),
    "rename_analysis": lambda s, d: R.rename_analysis(V.analyses(s, d), 9, "New title").select("call_id", "title"),
    "name_voice": lambda s, d: R.name_voice(V.voice_prints(s, d).select("call_id", "speaker_id", "name"), 5, 1, "Ann"),
    "commit_analyses": _commit,
    "save_plugin_results": lambda s, d: _plugin_rows(s, d).select("call_id", "plugin", "payload"),
    "edit_transcripts": lambda s, d: R.edit_transcript(_transcripts(s, d), _transcripts(s, d).where("call_id % 5 = 0").select("call_id", F.lit("{}").alias("transcript_json")), NOW).select("call_id", "transcript_json", F.date_format("created_at", STAMP).alias("created_at"), F.date_format("updated_at", STAMP).alias("updated_at")),
    "label_transcripts": lambda s, d: R.labelled_json(_transcripts(s, d), {0: "Ann", 1: "Bob"}).select("call_id", "transcript_json", "changed"),
    "recordings_written": lambda s, d: R.delete_recordings(R.add_recordings(V.recordings(s, d), V.recordings(s, d).where("id % 10 = 1").withColumn("id", F.col("id") + 8)), V.recordings(s, d).where("id % 10 = 2")).select("id", "call_id"),
    "set_audio_metadata": _audio,
    "metadata_backfill": lambda s, d: R.backfill(V.calls(s, d), V.recordings(s, d), V.recordings(s, d).groupBy("object_key").agg(F.max("duration_ms").alias("duration_ms")).where("duration_ms > 20000")),
    "rfc3339": lambda s, d: V.calls(s, d).select("id", R.rfc3339(F.col("created_at")).alias("text"), F.date_format(R.from_rfc3339(F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.expr("CASE id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE 'x' END"))), STAMP).alias("utc")),
    "index_built": lambda s, d: _totals(_index(s, d)),
    "index_replaced": lambda s, d: _totals(_index(s, d).replaced(I.entries(V.index_rows(s, d).where("call_id % 4 = 0").withColumn("transcript", F.lit("Only this text"))))),
    "index_retitled": lambda s, d: _totals(_index(s, d).retitled(V.index_rows(s, d).where("call_id % 4 = 0").select((F.col("call_id") * 2).alias("call_id"), F.lit("A new title").alias("title")))),
    "index_deleted": lambda s, d: _totals(_index(s, d).without(V.index_rows(s, d).select((F.col("call_id") * 3).alias("call_id")))),
    "index_search": lambda s, d: _saved(s, d).ranked(QUERY).withColumn("score", F.round("score", 6)),
    "index_search_filtered": lambda s, d: I.searched(_saved(s, d), V.calls(s, d), QUERY, organization_id=2, created_from="1993-01-01", created_to="1997-12-31", direction="incoming", status="completed", limit=20, offset=1).select("call_id", "score"),
    "index_search_blank": lambda s, d: V.calls(s, d).join(I.searched(_index(s, d), V.calls(s, d), " *() ").select(F.col("call_id").alias("id"), "score"), "id", "left").groupBy("status").agg(F.count("*").alias("calls"), F.count("score").alias("hits")),
    "call_list_search": lambda s, d: I.listed(V.calls(s, d), _saved(s, d), "place7").select("id", "external_id"),
    "call_list_search_id": lambda s, d: I.listed(V.calls(s, d), _saved(s, d), "call-12").select("id", "external_id"),
    "answers_coerced": _coerced,
    "answers_scored": _scored,
    "json_shape": lambda s, d: _answers(s, d).select("call_id", F.coalesce(A.shape(F.col("answer")), F.lit("no object")).alias("shape")),
    "lenient_prose": lambda s, d: _answers(s, d).select("call_id", L.prose_of(F.coalesce(F.get_json_object("answer", "$.topics"), F.get_json_object("answer", "$.key_facts"), F.lit("N/A"))).alias("prose")),
    "byte_ranges": lambda s, d: V.calls(s, d).withColumn("r", T.byte_range(F.expr("CASE id % 4 WHEN 0 THEN concat('bytes=', id, '-') WHEN 1 THEN 'bytes=-100' WHEN 2 THEN 'bytes=10-5000000' ELSE 'bytes=9-3' END"), F.lit(100_000))).select("id", "r.first", "r.last"),
    "parties": lambda s, d: V.calls(s, d).select("id", T.parties(F.when(F.col("id") % 2 == 0, F.lit("a")), F.when(F.col("id") % 3 == 0, T.number_of_jid(F.concat(F.col("id").cast("string"), F.lit("@s.whatsapp.net"))))).alias("parties")),
    "enqueued_jobs": lambda s, d: queue.enqueued(V.jobs(s, d).where("status = 'pending'"), V.calls(s, d).where("status = 'completed'").select(F.col("id").alias("call_id"), F.lit("transcribe").alias("kind"), F.when(F.col("id") % 2 == 0, F.col("created_at")).alias("run_after")), NOW).groupBy("kind", "status", "attempt", (F.col("run_after") == F.lit(NOW).cast("timestamp_ntz")).alias("due_now")).agg(F.count("*").alias("n")),
    "renewed_lock": lambda s, d: queue.renewed(V.jobs(s, d), 21, "w1", NOW).where("status = 'running'").select("id", "locked_by", F.date_format("locked_at", STAMP).alias("locked_at")),
    "range_speakers": lambda s, d: K.range_speakers(V.segments(s, d).select("call_id", "sequence", (F.col("start_ms") + 350).alias("start_ms"), (F.col("end_ms") + 350).alias("end_ms")), V.turns(s, d)),
    "chunk_speech": lambda s, d: K.chunk_speech(K.frame_classes(V.voice_prints(s, d), "embedding")),
    "language_windows": lambda s, d: K.language_windows(V.calls(s, d).where("duration_ms IS NOT NULL").select(F.col("id").alias("call_id"), "duration_ms"), V.segments(s, d)),
    "diarizer_choice": lambda s, d: V.calls(s, d).select("id", K.diarizer(F.expr("CASE id % 4 WHEN 0 THEN 'separated' WHEN 1 THEN 'mono' ELSE 'mixed' END"), F.lit(2), F.expr("id % 5 <> 0")).alias("diarizer"), K.speakers_wanted(F.expr("CASE WHEN id % 3 = 0 THEN id % 40 END"), F.expr("CASE WHEN id % 3 = 1 THEN id % 7 END"), F.lit(10)).alias("speakers")),
    "real_time_factor": lambda s, d: K.real_time_factors(V.calls(s, d).where("duration_ms IS NOT NULL").select(F.col("status").alias("engine"), "duration_ms", (F.col("duration_ms") / 4).alias("took_ms"))),
    "mean_duration": lambda s, d: V.calls(s, d).groupBy("status").agg(F.avg("duration_ms").alias("ms")).select("status", T.mm_ss(F.floor("ms")).alias("mean")),
    "entity_icons": lambda s, d: V.table(s, d, "documents").select(F.col("doc_id").alias("call_id"), K.icon(F.expr("CASE doc_id % 6 WHEN 0 THEN 'Location' WHEN 1 THEN 'PERSON' WHEN 2 THEN 'phone number' WHEN 3 THEN 'Date' WHEN 4 THEN 'amount' ELSE source END")).alias("icon")),
}

_T = "list_transform(regexp_extract_all(translate(lower({0}), '" + MARKED + "', '" + PLAIN + "'), '[\\p{{L}}\\p{{N}}]+'), lambda x: x)"


def _flat(rows: str) -> str:
    return "flat AS (" + " UNION ALL ".join(f"SELECT call_id, '{c}' AS \"column\", {_T.format(c)} AS terms FROM {rows}" for c in I.COLUMNS) + ")"


_TOTALS = "SELECT \"column\", entries, words, postings, tf, letters FROM (SELECT \"column\", count(*) AS entries, sum(len(terms))::BIGINT AS words FROM flat GROUP BY 1) JOIN (SELECT \"column\", count(*) AS postings, sum(tf)::BIGINT AS tf, sum(length(term))::BIGINT AS letters FROM (SELECT call_id, \"column\", term, count(*) AS tf FROM (SELECT call_id, \"column\", unnest(terms) AS term FROM flat) GROUP BY ALL) GROUP BY 1) USING (\"column\")"
_HITS = """c AS (SELECT call_id, sum(len(terms)) AS dl, sum(len(list_filter(terms, lambda t: starts_with(t, 'thanti')))) AS tf0, sum(len(list_filter(terms, lambda t: starts_with(t, 'cafe')))) AS tf1, sum(len(list_filter(terms, lambda t: starts_with(t, 'place7')))) AS tf2 FROM flat GROUP BY 1),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE tf0 > 0) AS df0, count(*) FILTER (WHERE tf1 > 0) AS df1, count(*) FILTER (WHERE tf2 > 0) AS df2 FROM c),
hits AS (SELECT call_id, round(""" + " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in range(3)) + ", 6) AS score FROM c, s WHERE tf0 > 0 OR tf1 > 0 OR tf2 > 0)"
_STAMPED = "created_at, '%Y-%m-%d %H:%M:%S'"
_STORED = "stored AS (SELECT doc_id AS call_id, CASE WHEN doc_id % 7 <> 0 THEN '{\"segments\":[{\"sequence\":0,\"speaker_id\":' || (doc_id % 3) || {0} || ',\"text\":\"a\"},{\"sequence\":1,\"speaker_id\":1,\"speaker_label\":\"{1}\",\"text\":\"b\"}]}' ELSE '[1]' END AS transcript_json FROM documents)"


def _stored(label: str = "''", second: str = "x") -> str:
    return _STORED.replace("{0}", label).replace("{1}", second)


def _by_shape(*values: str) -> str:
    return "CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


SQL = {
    "recording_by_call": sql(V.RECORDINGS, body="SELECT * FROM recordings WHERE call_id = 7 ORDER BY id LIMIT 1"),
    "analysis_by_call": sql(V.ANALYSES, body="SELECT call_id, title, CASE WHEN resolved THEN 'true' ELSE 'false' END AS resolved FROM analyses WHERE call_id = 9"),
    "organization_name": "SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region WHERE r_regionkey = 2",
    "job_lookup": sql(V.JOBS, body="SELECT id, call_id, kind, status, attempt FROM jobs WHERE id = 11"),
    "plugin_results_of_call": r"SELECT 'word_count' AS plugin, len(regexp_extract_all(text, '\S+')) AS words FROM documents WHERE doc_id = 9",
    "speakers_of_call": sql(V.VOICE_PRINTS, body="SELECT speaker_id, name, 4 * len(embedding) AS bytes, round(embedding[1]::FLOAT::DOUBLE, 4) AS x FROM voice_prints WHERE call_id = 5"),
    "update_status": sql(V.CALLS, body=f"SELECT id, CASE WHEN id = 7 THEN 'failed' ELSE status END AS status, CASE WHEN id = 7 THEN '{NOW}' ELSE strftime({_STAMPED}) END AS updated_at FROM calls"),
    "replace_tags": sql(V.CALLS, body="SELECT id, CASE WHEN id = 7 THEN '[\"vip\",\"a \\\"b\\\"\"]' ELSE '[]' END AS tags, CASE WHEN id = 7 THEN 2 ELSE 0 END AS n FROM calls"),
    "rename_analysis": sql(V.ANALYSES, body="SELECT call_id, CASE WHEN call_id = 9 THEN 'New title' ELSE title END AS title FROM analyses"),
    "name_voice": sql(V.VOICE_PRINTS, body="SELECT call_id, speaker_id, CASE WHEN call_id = 5 AND speaker_id = 1 THEN 'Ann' ELSE name END AS name FROM voice_prints"),
    "commit_analyses": sql(V.CALLS, V.ANALYSES, body="SELECT id, CASE WHEN call_id % 2 = 1 THEN 'completed' ELSE status END AS status, CASE WHEN call_id % 2 = 1 THEN 'again' ELSE title END AS title FROM calls LEFT JOIN analyses ON call_id = id"),
    "save_plugin_results": "WITH r AS (SELECT user_id AS call_id, event_type AS plugin, event_id::VARCHAR AS payload, ts, event_id % 2 AS new FROM events), n AS (SELECT call_id, plugin, arg_max(payload, (ts, payload)) AS payload FROM r WHERE new = 1 GROUP BY 1, 2) SELECT * FROM n UNION ALL SELECT call_id, plugin, max(payload) FROM r WHERE new = 0 AND (call_id, plugin) NOT IN (SELECT (call_id, plugin) FROM n) GROUP BY 1, 2",
    "edit_transcripts": sql(_stored(), body=f"SELECT call_id, CASE WHEN call_id % 5 = 0 THEN '{{}}' ELSE transcript_json END AS transcript_json, '2024-01-01 00:00:00' AS created_at, CASE WHEN call_id % 5 = 0 THEN '{NOW}' ELSE '2024-01-01 00:00:00' END AS updated_at FROM stored"),
    "label_transcripts": sql(_stored("CASE doc_id % 3 WHEN 0 THEN ',\"speaker_label\":\"Ann\"' WHEN 1 THEN ',\"speaker_label\":\"Bob\"' ELSE '' END", "Bob"), body="SELECT call_id, transcript_json, CASE WHEN call_id % 7 = 0 THEN 0 WHEN call_id % 3 = 2 THEN 1 ELSE 2 END AS changed FROM stored"),
    "recordings_written": sql(V.RECORDINGS, body="SELECT id, call_id FROM recordings WHERE id % 10 <> 2 UNION ALL SELECT id + 8, call_id FROM recordings WHERE id % 10 = 1"),
    "set_audio_metadata": sql(V.CALLS, V.RECORDINGS, body="SELECT 'call' AS kind, id, CASE WHEN id % 4 = 1 THEN id * 10 ELSE duration_ms END AS duration_ms, CASE WHEN id % 4 = 1 THEN 2 END AS channels FROM calls UNION ALL SELECT 'recording', id, CASE WHEN call_id % 4 = 1 AND call_id IN (SELECT id FROM calls) THEN call_id * 10 ELSE duration_ms END, NULL FROM recordings"),
    "metadata_backfill": sql(V.CALLS, V.RECORDINGS, "f AS (SELECT call_id, min(id) AS first FROM recordings GROUP BY 1)", "m AS (SELECT id, max(duration_ms) AS duration_ms FROM recordings GROUP BY 1)", body="SELECT c.id, CASE WHEN r.duration_ms > 20000 THEN 'filled' ELSE 'skipped' END AS outcome, CASE WHEN r.duration_ms > 20000 THEN r.duration_ms END AS duration_ms FROM calls c LEFT JOIN f ON f.call_id = c.id LEFT JOIN m r ON r.id = f.first WHERE c.duration_ms IS NULL"),
    "rfc3339": sql(V.CALLS, body="SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS text, CASE id % 3 WHEN 0 THEN strftime(created_at, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(created_at - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS utc FROM calls"),
    "index_built": sql(V.INDEX_ROWS, _flat("index_rows"), body=_TOTALS),
    "index_replaced": sql(V.INDEX_ROWS, "r AS (SELECT * REPLACE (CASE WHEN call_id % 4 = 0 THEN 'Only this text' ELSE transcript END AS transcript) FROM index_rows)", _flat("r"), body=_TOTALS),
    "index_retitled": sql(V.INDEX_ROWS, "r AS (SELECT * REPLACE (CASE WHEN call_id % 8 = 0 AND call_id // 2 IN (SELECT doc_id FROM documents) THEN 'A new title' ELSE title END AS title) FROM index_rows)", _flat("r"), body=_TOTALS),
    "index_deleted": sql(V.INDEX_ROWS, "r AS (SELECT * FROM index_rows WHERE call_id NOT IN (SELECT 3 * doc_id FROM documents))", _flat("r"), body=_TOTALS),
    "index_search": sql(V.INDEX_ROWS, _flat("index_rows"), _HITS, body="SELECT * FROM hits"),
    "index_search_filtered": sql(V.INDEX_ROWS, V.CALLS, _flat("index_rows"), _HITS, body="SELECT call_id, score FROM hits JOIN calls ON id = call_id WHERE organization_id = 2 AND created_at BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1997-12-31' AND direction = 'incoming' AND status = 'completed' ORDER BY score DESC, created_at DESC, call_id LIMIT 20 OFFSET 1"),
    "index_search_blank": sql(V.CALLS, body="SELECT status, count(*) AS calls, 0::BIGINT AS hits FROM calls GROUP BY 1"),
    "call_list_search": sql(V.CALLS, body="SELECT id, external_id FROM calls WHERE external_id LIKE '%place7%' OR id IN (SELECT doc_id FROM documents WHERE doc_id % 20 = 7)"),
    "call_list_search_id": sql(V.CALLS, V.INDEX_ROWS, _flat("index_rows"), body="SELECT id, external_id FROM calls WHERE external_id LIKE '%call-12%' OR id IN (SELECT call_id FROM flat WHERE len(list_filter(terms, lambda t: starts_with(t, 'call-12'))) > 0)"),
    "answers_coerced": "SELECT doc_id AS call_id, "
    + _by_shape("'Recorded conversation'", "'Late parcel'", "'Recorded conversation'", "'Recorded conversation'") + " AS title, "
    + _by_shape("'opening'", "'The parcel is late.'", "'opening'", "'opening'") + " AS summary, "
    + _by_shape("'a,b'", "'one'", "'one,two'", "''") + " AS topics, " + _by_shape("'one,two'", "'f1'", "''", "''") + " AS facts, "
    + _by_shape("'call back/-/-'", "'wait/participant/-; send/speaker_1/-'", "'check/speaker_2/today'", "''") + " AS items, "
    + _by_shape("'place=Rome'", "'entity=x'", "'phone=12'", "''") + " AS entities, " + _by_shape("80", "NULL", "NULL", "NULL") + "::BIGINT AS score, "
    + _by_shape("'greets/5/100'", "NULL", "NULL", "NULL") + " AS rules, " + _by_shape("'consent=false; Policy=true'", "''", "''", "''") + " AS checks FROM documents",
    "answers_scored": "WITH t AS (SELECT *, doc_id % 5 <> 0 OR doc_id % 4 = 0 AS ok FROM documents) SELECT doc_id AS call_id, CASE WHEN ok THEN n_chars END::BIGINT AS total, CASE WHEN ok THEN source END AS rule, CASE WHEN ok THEN CASE WHEN doc_id % 4 = 0 THEN doc_id ELSE 0 END END AS score, CASE WHEN ok THEN lang END AS explanation, lang AS check_name, doc_id % 3 <> 0 AS passed,"
    " (doc_id % 9) || CASE WHEN doc_id % 4 = 0 OR (doc_id % 4 = 3 AND doc_id % 7 = 0) THEN ',' || (doc_id % 7) ELSE '' END AS evidence, CASE doc_id % 4 WHEN 1 THEN lang WHEN 2 THEN source ELSE 'heuristic' END AS topics, doc_id % 2 <> 0 AS resolved, (doc_id % 10)::DOUBLE AS sentiment, CASE WHEN doc_id % 2 = 0 THEN lang || '; ' || doc_id ELSE 'unsaid' END AS reason FROM t",
    "json_shape": "SELECT doc_id AS call_id, " + _by_shape("'action_items=array compliance=array entities=object key_facts=object scorecard=object summary=string title=string topics=array'", "'action_items=object entities=array key_facts=array scorecard=object summary=string title=string topics=string'", "'action_items=array compliance=string entities=array title=null topics=object'", "'no object'") + " AS shape FROM documents",
    "lenient_prose": "SELECT doc_id AS call_id, " + _by_shape("'a; 1; b'", "'one'", "'two; one'", "NULL") + " AS prose FROM documents",
    "byte_ranges": sql(V.CALLS, body="SELECT id, CASE id % 4 WHEN 0 THEN CASE WHEN id < 100000 THEN id END WHEN 1 THEN 99900 WHEN 2 THEN 10 END AS first, CASE WHEN id % 4 = 3 OR (id % 4 = 0 AND id >= 100000) THEN NULL ELSE 99999 END::BIGINT AS last FROM calls"),
    "parties": sql(V.CALLS, body="SELECT id, CASE WHEN id % 6 = 0 THEN 'a → ' || id WHEN id % 2 = 0 THEN 'a' WHEN id % 3 = 0 THEN id::VARCHAR ELSE '—' END AS parties FROM calls"),
    "enqueued_jobs": sql(V.JOBS, V.CALLS, "u AS (SELECT kind, status, attempt, run_after FROM jobs WHERE status = 'pending' UNION ALL SELECT 'transcribe', 'pending', 0, CASE WHEN id % 2 = 0 THEN created_at ELSE TIMESTAMP '2024-02-01' END FROM calls WHERE status = 'completed')", body="SELECT kind, status, attempt, run_after = TIMESTAMP '2024-02-01' AS due_now, count(*) AS n FROM u GROUP BY ALL"),
    "renewed_lock": sql(V.JOBS, body="SELECT id, locked_by, CASE WHEN id = 21 AND locked_by = 'w1' THEN '2024-02-01 00:00:00' ELSE strftime(locked_at, '%Y-%m-%d %H:%M:%S') END AS locked_at FROM jobs WHERE status = 'running'"),
    "range_speakers": sql(V.SEGMENTS, V.TURNS, "q AS (SELECT call_id, sequence, start_ms + 350 AS s, end_ms + 350 AS e FROM segments)", "p AS (SELECT q.call_id, q.sequence, t.speaker_id, row_number() OVER (PARTITION BY q.call_id, q.sequence ORDER BY greatest(least(t.end_ms, e) - greatest(t.start_ms, s), 0) DESC, CASE WHEN e <= t.start_ms THEN t.start_ms - e ELSE greatest(s - t.end_ms, 0) END, t.start_ms, t.turn) AS k FROM q LEFT JOIN turns t ON t.call_id = q.call_id)", body="SELECT call_id, sequence, coalesce(speaker_id, 0)::INTEGER AS speaker_id FROM p WHERE k = 1"),
    "chunk_speech": sql(V.VOICE_PRINTS, "f AS (SELECT call_id, id // 40 AS chunk, list_position(embedding[1:7], list_max(embedding[1:7])) - 1 AS c FROM (SELECT id // 400 AS call_id, id, embedding FROM voice_prints))", "k AS (SELECT call_id, chunk, greatest(max(CASE WHEN c IN (1, 4, 5) THEN 1 ELSE 0 END) + max(CASE WHEN c IN (2, 4, 6) THEN 1 ELSE 0 END) + max(CASE WHEN c IN (3, 5, 6) THEN 1 ELSE 0 END), 1) AS speakers, count(*) AS n, sum((c > 0)::INT) AS spoken FROM f GROUP BY ALL)", body="SELECT call_id, round(sum(spoken) / sum(n), 6) AS speech_ratio, list_sort(list(speakers))[count(*) // 2 + 1]::BIGINT AS speakers, count(*) AS chunks FROM k GROUP BY 1"),
    "language_windows": sql(V.CALLS, V.SEGMENTS, "c AS (SELECT id AS call_id, duration_ms FROM calls WHERE duration_ms IS NOT NULL)", "r AS (SELECT call_id, start_ms, least(end_ms, start_ms + 15000) AS end_ms, row_number() OVER (PARTITION BY call_id ORDER BY start_ms, end_ms) AS k FROM segments)", "e AS (SELECT call_id, k * step AS start_ms, least(k * step + 15000, duration_ms) AS end_ms FROM (SELECT call_id, duration_ms, greatest(duration_ms // 5, 1000) AS step, unnest(range(1, 5)) AS k FROM c WHERE call_id NOT IN (SELECT call_id FROM segments)))", "w AS (SELECT r.call_id, start_ms, end_ms FROM r JOIN c USING (call_id) WHERE k <= 4 AND start_ms < end_ms UNION ALL SELECT call_id, start_ms, end_ms FROM e WHERE start_ms < end_ms)", body="SELECT * FROM w UNION ALL SELECT call_id, 0, duration_ms FROM c WHERE call_id NOT IN (SELECT call_id FROM w)"),
    "diarizer_choice": sql(V.CALLS, body="SELECT id, CASE WHEN id % 4 = 0 THEN 'channels' WHEN id % 5 <> 0 THEN 'neural' ELSE 'acoustic' END AS diarizer, CASE id % 3 WHEN 0 THEN least(greatest(id % 40, 1), 10) WHEN 1 THEN least(greatest(id % 7, 1), 10) ELSE 2 END::BIGINT AS speakers FROM calls"),
    "real_time_factor": sql(V.CALLS, body="SELECT status AS engine, count(*) AS n, sum(duration_ms)::BIGINT AS audio_ms, round(sum(duration_ms / 4) / sum(duration_ms), 6) AS factor FROM calls WHERE duration_ms IS NOT NULL GROUP BY 1"),
    "mean_duration": sql(V.CALLS, "m AS (SELECT status, floor(avg(duration_ms))::BIGINT AS ms FROM calls GROUP BY 1)", body="SELECT status, lpad((ms // 60000)::VARCHAR, 2, '0') || ':' || lpad((ms % 60000 // 1000)::VARCHAR, 2, '0') AS mean FROM m"),
    "entity_icons": "SELECT doc_id AS call_id, CASE doc_id % 6 WHEN 0 THEN 'place' WHEN 1 THEN 'person' WHEN 2 THEN 'phone' WHEN 3 THEN 'time' WHEN 4 THEN 'money' ELSE 'tag' END AS icon FROM documents",
}
