"""Transcripts, turns and voices."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import emotions as E
from parlance.operators import clustering, joins, language, plugins
from parlance.operators import entities as N
from parlance.operators import conversation as C
from parlance.operators import signal as G
from parlance.sources import views as V
from parlance.sources.views import sql


def _words(s, d):
    """Words with an ordinal in the call, and a language that changes now and then."""
    w = V.words(s, d)
    lang = F.expr("CASE WHEN sequence % 5 = 4 THEN NULL WHEN sequence % 5 = 3 THEN 'fr' ELSE 'en' END")
    return w.withColumn("ordinal", F.col("sequence") * 100_000 + F.col("pos")).withColumn("language", lang)


_WORDS_SQL = "w AS (SELECT call_id, sequence * 100000 + pos AS ordinal, word, coalesce(speaker_id, 0) AS speaker_id, CASE WHEN sequence % 5 = 4 THEN 'unknown' WHEN sequence % 5 = 3 THEN 'fr' ELSE 'en' END AS language, start_ms, end_ms FROM words)"


def _emotions(s, d):
    t = V.table(s, d, "conversations")
    lang = F.expr("CASE turn % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ru' ELSE 'he' END")
    # the hits in a projection of their own: each is used by every share
    t = t.select("conv_id", "turn", *[E.hits(F.col("text"), lang, e).alias(e) for e in E.EMOTIONS])
    shares, dominant = E.distribution({e: F.col(e) for e in E.EMOTIONS})
    return t.select(F.col("conv_id").alias("call_id"), "turn", *[F.round(c, 6).alias(e) for e, c in shares.items()], dominant.alias("dominant"))


def _emotions_sql() -> str:
    def hits(emotion: str, lang: str) -> str:
        return " + ".join(f"contains(lower(text), '{w}')::INT" for w in E.LEXICON[lang][emotion])

    counts = ", ".join(f"CASE turn % 3 WHEN 1 THEN {hits(e, 'ru')} WHEN 2 THEN {hits(e, 'he')} ELSE {hits(e, 'he')} + {hits(e, 'ru')} + {hits(e, 'en')} END AS {e}" for e in E.EMOTIONS)
    total = " + ".join(E.EMOTIONS)
    shares = ", ".join(f"CASE WHEN total > 0 THEN round({e} / total, 6) ELSE 0 END::DOUBLE AS {e}" for e in E.EMOTIONS)
    best = f"greatest({', '.join(E.EMOTIONS)})"
    dominant = "CASE WHEN total = 0 THEN 'neutral' " + " ".join(f"WHEN {e} = {best} THEN '{e}'" for e in E.EMOTIONS) + " END"
    return f"WITH c AS (SELECT conv_id, turn, {counts} FROM conversations), t AS (SELECT *, {total} AS total FROM c) SELECT conv_id AS call_id, turn, {shares}, (CASE WHEN total > 0 THEN round(greatest(0, 1 - least(total / 5, 1)), 6) ELSE 1 END)::DOUBLE AS neutral, {dominant} AS dominant FROM t"


def _samples(s, d):
    """Each user's events as a signal."""
    from pyspark.sql import Window

    e = V.table(s, d, "events")
    x = F.expr("(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) * value / 1000")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint") - 1
    return e.select(F.col("user_id").alias("call_id"), "event_id", x.alias("x")).withColumn("user_id", F.col("call_id")).select("call_id", i.alias("i"), "x", F.expr("CASE WHEN event_id % 2 = 0 THEN x ELSE x / 2 END").alias("y"))


_SAMPLES = "samples AS (SELECT user_id AS call_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, (CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) * value / 1000 AS x, CASE WHEN event_id % 2 = 0 THEN (CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) * value / 1000 ELSE (CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) * value / 1000 / 2 END AS y FROM events)"
_FRAMES = """f1 AS (SELECT call_id, i // 4 AS frame, x, lag(x) OVER (PARTITION BY call_id, i // 4 ORDER BY i) AS p FROM samples),
frames AS (SELECT call_id, frame, sqrt(avg(x * x)) AS energy, sum(CASE WHEN (x >= 0 AND p < 0) OR (x < 0 AND p >= 0) THEN 1 ELSE 0 END) / count(*) AS zcr FROM f1 GROUP BY ALL HAVING count(*) = 4)"""
_VAD = """r1 AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY energy, frame) - 1 AS rank, count(*) OVER (PARTITION BY call_id) AS n FROM frames),
r2 AS (SELECT *, max(CASE WHEN rank = n * 15 // 100 THEN energy END) OVER (PARTITION BY call_id) AS floor FROM r1),
r3 AS (SELECT *, frame - row_number() OVER (PARTITION BY call_id ORDER BY frame) AS run FROM r2 WHERE zcr > 0.005 AND energy >= CASE WHEN floor > 0.05 THEN floor * 0.75 ELSE least(greatest(floor * 2.5, 0.005), 0.05) END),
r4 AS (SELECT call_id, run, min(frame) * 30 AS s, (max(frame) + 1) * 30 AS e, max(n) * 30 AS total FROM r3 GROUP BY ALL),
r5 AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY call_id ORDER BY s) <= 300 THEN 0 ELSE 1 END AS new FROM r4),
r6 AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS region FROM r5),
r7 AS (SELECT call_id, region, min(s) AS s, max(e) AS e, max(total) AS total FROM r6 GROUP BY ALL)"""


def _votes(s, d):
    e = V.table(s, d, "events")
    k = F.expr("CASE event_type WHEN 'click' THEN 'he' WHEN 'view' THEN 'ru' WHEN 'purchase' THEN 'en' ELSE 'ar' END")
    return e.select(F.col("user_id").alias("call_id"), F.call_function("div", F.col("event_id"), F.lit(3).cast("bigint")).alias("window"), k.alias("language"), F.lit(1.0 / 3).alias("probability"))


_VOTES = "votes AS (SELECT user_id AS call_id, event_id // 3 AS win, CASE event_type WHEN 'click' THEN 'he' WHEN 'view' THEN 'ru' WHEN 'purchase' THEN 'en' ELSE 'ar' END AS language, 1.0::DOUBLE / 3 AS probability FROM events), v AS (SELECT call_id, language, round(sum(probability) / any_value(n), 6) AS p FROM votes JOIN (SELECT call_id, count(DISTINCT win) AS n FROM votes GROUP BY 1) USING (call_id) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY p DESC, language) AS r FROM v)"


def _prints(s, d):
    return V.voice_prints(s, d).withColumn("organization_id", F.col("call_id") % 5)


_COS = "least(greatest(1 - list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))), 0), 2)"


def _grouped(s, d):
    """Voice prints in groups of about forty, as the windows of one call each."""
    return V.voice_prints(s, d).select("id", F.call_function("div", F.col("id"), F.lit(40).cast("bigint")).alias("call_id"), "embedding")


def _tokens(s, d):
    """Words cut into a recogniser's tokens: up to three characters with a blank in front, then the rest."""
    w = V.words(s, d).withColumn("n", F.col("sequence") * 200_000 + F.col("pos") * 2)
    token = lambda n, text, start, end, p: F.struct(n.alias("ordinal"), text.alias("token"), start.alias("start_ms"), end.alias("end_ms"), F.lit(p).alias("probability"))
    half = F.col("start_ms") + 200
    first = token(F.col("n"), F.concat(F.lit(" "), F.substring("word", 1, 3)), F.col("start_ms"), half, 0.9)
    rest = token(F.col("n") + 1, F.expr("substring(word, 4)"), half, F.col("end_ms"), 0.5)
    # exploded where the words are, so that a call's tokens stay together and aren't shuffled
    return w.select("call_id", F.explode(F.when(F.length("word") > 3, F.array(first, rest)).otherwise(F.array(first))).alias("t")).select("call_id", "t.*")


def _tokens_of_segments(s, d):
    """Tokens with control tokens among them, and segments; every fifth segment has control tokens only."""
    w = V.words(s, d).withColumn("n", F.col("pos") * 3)
    token = lambda n, text, start, end, p: F.struct(n.alias("ordinal"), text.alias("token"), start.alias("start_ms"), end.alias("end_ms"), F.lit(p).alias("probability"))
    half = F.col("start_ms") + 200
    first = token(F.col("n"), F.concat(F.lit(" "), F.substring("word", 1, 3)), F.col("start_ms"), half, 0.9)
    rest = token(F.col("n") + 1, F.expr("substring(word, 4)"), half, F.col("end_ms"), 0.5)
    mark = token(F.col("n") + 2, F.concat(F.lit("[_TT_"), F.col("pos").cast("string"), F.lit("]")), F.col("start_ms"), F.col("end_ms"), 0.1)
    of = F.when(F.col("segment") % 5 == 4, F.array(mark)).when(F.length("word") > 3, F.array(first, rest, mark)).otherwise(F.array(first, mark))
    tokens = w.withColumnRenamed("sequence", "segment").select("call_id", "segment", F.explode(of).alias("t")).select("call_id", "segment", "t.*")
    segments = V.segments(s, d).select("call_id", F.col("sequence").alias("segment"), (F.col("start_ms") + 100).alias("start_ms"), (F.col("end_ms") - 300).alias("end_ms"), F.col("raw_text").alias("text"))
    return C.words_of_tokens(tokens, segments).select("call_id", "segment", "word_no", "word", "start_ms", "end_ms", F.round("confidence", 6).alias("confidence"))


def _diarized(s, d):
    """Windows of a second for every voice print of a call, labelled by clustering, merged to turns."""
    rows = _grouped(s, d)
    windows = rows.select("call_id", "id", ((F.col("id") % 40) * 400).alias("window_start"), ((F.col("id") % 40) * 400 + 800).alias("window_end"))
    return C.diarized(windows, clustering.by_call(rows, "call_id", lambda x: clustering.clustered(x, None, 3)))


def _entities(s, d):
    """Analyses with entities in JSON."""
    j = F.expr("concat('{\"entities\": [{\"entity_type\": \"', CASE call_id % 4 WHEN 0 THEN 'Location' WHEN 1 THEN 'person' WHEN 2 THEN 'Phone number' ELSE 'address' END, '\", \"value\": \"v', call_id, '\"}]}')")
    return V.analyses(s, d).select("call_id", "title", F.when(F.col("resolved"), "Resolved.").alias("summary"), F.expr("CASE WHEN call_id % 5 = 0 THEN 'Schedule a visit' END").alias("reason"), j.alias("analysis_json"))


_ENTITIES = "ents AS (SELECT call_id, title, resolved, CASE call_id % 4 WHEN 0 THEN 'Location' WHEN 1 THEN 'person' WHEN 2 THEN 'Phone number' ELSE 'address' END AS kind, CASE WHEN call_id % 5 = 0 THEN 'Schedule a visit' END AS reason FROM analyses)"

QUERIES = {
    "words_of_tokens": lambda s, d: C.words_of_tokens(_tokens(s, d)).select("call_id", "word_no", "word", "start_ms", "end_ms", F.round("confidence", 6).alias("confidence")),
    "words_of_segments": _tokens_of_segments,
    "counting_windows": lambda s, d: C.counting_windows(V.segments(s, d).select("call_id", "sequence", "start_ms", "end_ms"), most=64),
    "fixed_chunks": lambda s, d: C.fixed_chunks(V.calls(s, d).where("duration_ms IS NOT NULL").select(F.col("id").alias("call_id"), "duration_ms")),
    "renumber_labels": lambda s, d: C.renumbered(_grouped(s, d).join(V.voice_prints(s, d).select("id", "label"), "id"), "call_id", "label", "id").select("id", "call_id", "label", F.col("number").cast("bigint").alias("number")),
    "diarize_windows": _diarized,
    "stereo_turns": lambda s, d: C.stereo_turns(V.turns(s, d).where("speaker_id = 0"), V.turns(s, d).where("speaker_id = 1")).select("call_id", "speaker_id", "start_ms", "end_ms", F.col("turn").cast("bigint").alias("turn")),
    "valid_transcripts": lambda s, d: C.valid_transcripts(V.segments(s, d).withColumn("speaker_id", F.expr("CASE WHEN call_id % 10 = 3 AND sequence = 2 THEN 70000 ELSE speaker_id END"))),
    "segment_classes": lambda s, d: V.voice_prints(s, d).select("id", F.array_join(G.active_speakers(F.slice("embedding", 1, 7)).cast("array<string>"), "+").alias("speakers"), G.upper_median(F.transform(F.slice("embedding", 1, 5), lambda x: F.floor(F.abs(x) * 10))).cast("bigint").alias("median")),
    "calendar_entities": lambda s, d: _entities(s, d).select("call_id", N.first_place(N.entities(F.col("analysis_json"))).alias("place"), N.is_calendar_event(N.entities(F.col("analysis_json")), F.col("reason")).alias("is_event"), N.badge(F.expr("CASE call_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'pending' END")).alias("badge")),
    "call_messages": lambda s, d: N.message(_entities(s, d)),
    "conversation_metrics": lambda s, d: C.conversation_metrics(V.segments(s, d)),
    "segment_words": lambda s, d: C.segmented(_words(s, d)),
    "merge_turns": lambda s, d: C.merged_turns(V.turns(s, d), 2500),
    "merge_intervals": lambda s, d: C.merged_intervals(V.segments(s, d).where("speaker_id = 1").withColumn("total_ms", F.col("end_ms")), "call_id", gap_ms=9000, least_ms=4000),
    "sliding_windows": lambda s, d: C.sliding_windows(V.segments(s, d).select("call_id", "sequence", "start_ms", "end_ms")),
    "speaker_metadata": lambda s, d: C.speaker_metadata(V.segments(s, d)),
    "speaker_roles": lambda s, d: C.speaker_roles(V.segments(s, d).withColumn("raw_text", F.expr("CASE WHEN call_id % 3 = 0 AND sequence = 1 THEN concat('Hello, how can I help? ', raw_text) ELSE raw_text END"))),
    "stereo_roles": lambda s, d: C.stereo_roles(V.segments(s, d).withColumn("raw_text", F.expr("CASE WHEN call_id % 3 = 0 AND speaker_id = 1 THEN concat('Thank you for calling ', raw_text) ELSE raw_text END"))),
    "sentiment_trajectory": lambda s, d: V.segments(s, d).join(V.analyses(s, d).select("call_id", "sentiment_score"), "call_id").select("call_id", "sequence", "start_ms", "sentiment_score"),
    "align_words_to_turns": lambda s, d: joins.aligned(V.words(s, d), V.turns(s, d)),
    "der_overlap_matrix": lambda s, d: joins.overlaps(V.segments(s, d).select("call_id", "speaker_id", "start_ms", "end_ms"), V.turns(s, d)),
    "der_evaluation": lambda s, d: joins.error_rate(V.segments(s, d).select("call_id", "speaker_id", "start_ms", "end_ms"), V.turns(s, d)),
    "identify_speakers": lambda s, d: joins.identified(_prints(s, d).where("name IS NULL"), _prints(s, d), 0.9),
    "speaker_centroids": lambda s, d: joins.centroids(V.voice_prints(s, d), "label").select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 5).alias("x")),
    "absorb_small_clusters": lambda s, d: joins.absorbed(_grouped(s, d).join(V.voice_prints(s, d).select("id", "label"), "id"), "call_id", 4),
    "ahc_clusters": lambda s, d: clustering.by_call(_grouped(s, d), "call_id", lambda x: clustering.clustered(x, 0.5)),
    "speaker_count": lambda s, d: clustering.by_call(_grouped(s, d), "call_id", lambda x: [clustering.speaker_count(x, 0.5, 3)] * len(x)).groupBy("call_id").agg(F.max("cluster").alias("speakers")),
    "emotion_distribution": _emotions,
    "vad_frames": lambda s, d: G.frames(_samples(s, d), "call_id", "i", "x", 4).select("call_id", "frame", F.round("energy", 6).alias("energy"), F.round("zcr", 6).alias("zcr")),
    "vad_regions": lambda s, d: G.speech_regions(G.frames(_samples(s, d), "call_id", "i", "x", 4), "call_id"),
    "frame_runs": lambda s, d: G.frame_runs(G.frames(_samples(s, d), "call_id", "i", "x", 4), "call_id", F.col("zcr") > 0.3, 30, gap_ms=60, least_ms=90),
    "channel_mode": lambda s, d: G.channel_modes(_samples(s, d), "call_id"),
    "window_language_vote": lambda s, d: language.primary_language(_votes(s, d)),
    "language_shares": lambda s, d: language.word_shares(_words(s, d).withColumn("language", F.coalesce("language", F.lit("unknown")))),
    "stt_route": lambda s, d: language.primary_language(_votes(s, d)).select("call_id", language.route(F.col("primary_language"), F.col("is_mixed"), F.col("confidence")).alias("route")),
    "language_samples": lambda s, d: language.sampled_regions(V.segments(s, d)),
    "mock_transcription": lambda s, d: plugins.mock_words(V.calls(s, d).where("duration_ms IS NOT NULL").select(F.col("id").alias("call_id"), "duration_ms", F.expr("CASE id % 4 WHEN 0 THEN 'he' WHEN 1 THEN 'ru' WHEN 2 THEN 'en' ELSE 'fr' END").alias("language"))),
    "plugin_results": lambda s, d: plugins.run_plugins(V.table(s, d, "documents").select(F.col("doc_id").alias("call_id"), "text"), ["word_count"]).select("call_id", "plugin", F.get_json_object("payload", "$.words").cast("bigint").alias("words")),
    "token_windows": lambda s, d: C.packed_lines(V.table(s, d, "documents").select("doc_id", "text"), "doc_id", "text", 200),
    "opening_text": lambda s, d: C.opening(V.segments(s, d)),
    "prompt_lines": lambda s, d: C.prompt_lines(V.segments(s, d)),
}

_RUNS = """r AS (SELECT *, sum(ch) OVER (PARTITION BY call_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN lag(speaker_role) OVER w = speaker_role THEN 0 ELSE 1 END AS ch, CASE WHEN lag(speaker_id) OVER w <> speaker_id THEN 1 ELSE 0 END AS sw,
    greatest(start_ms - coalesce(lag(end_ms) OVER w, 0), 0) AS gap FROM segments WINDOW w AS (PARTITION BY call_id ORDER BY sequence))),
m AS (SELECT call_id, speaker_role, run, sum(end_ms - start_ms) AS d FROM r GROUP BY ALL),
l AS (SELECT call_id, coalesce(max(d) FILTER (WHERE speaker_role = 'agent'), 0) AS am, coalesce(max(d) FILTER (WHERE speaker_role = 'customer'), 0) AS cm FROM m GROUP BY 1),
a AS (SELECT call_id, count(*) AS n_segments, arg_max(end_ms, sequence) AS duration_ms, sum(CASE WHEN gap >= 500 THEN gap ELSE 0 END)::BIGINT AS silence_ms, sum(sw)::BIGINT AS speaker_switches,
  coalesce(sum(end_ms - start_ms) FILTER (WHERE speaker_role = 'agent'), 0)::BIGINT AS agent_ms, coalesce(sum(end_ms - start_ms) FILTER (WHERE speaker_role = 'customer'), 0)::BIGINT AS customer_ms,
  coalesce(sum(n_words) FILTER (WHERE speaker_role = 'agent'), 0)::BIGINT AS agent_words, coalesce(sum(n_words) FILTER (WHERE speaker_role = 'customer'), 0)::BIGINT AS customer_words FROM r GROUP BY 1)"""
_SEGMENTED = """s1 AS (SELECT *, CASE WHEN lag(speaker_id) OVER o = speaker_id AND lag(language) OVER o = language AND start_ms <= lag(end_ms) OVER o + 1500 THEN 0 ELSE 1 END AS new FROM w WINDOW o AS (PARTITION BY call_id ORDER BY ordinal)),
s2 AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) - 1 AS sequence FROM s1)"""
_ALIGN = """p AS (SELECT w.call_id, w.sequence, w.pos, w.word, t.speaker_id AS turn_speaker, greatest(least(t.end_ms, w.end_ms) - greatest(t.start_ms, w.start_ms), 0) AS overlap_ms,
    row_number() OVER (PARTITION BY w.call_id, w.sequence, w.pos ORDER BY greatest(least(t.end_ms, w.end_ms) - greatest(t.start_ms, w.start_ms), 0) DESC,
      CASE WHEN w.end_ms <= t.start_ms THEN t.start_ms - w.end_ms ELSE greatest(w.start_ms - t.end_ms, 0) END, t.start_ms, t.turn) AS k
  FROM words w LEFT JOIN turns t ON t.call_id = w.call_id)"""
_PAIRS = "p AS (SELECT r.call_id, r.speaker_id AS ref_speaker, h.speaker_id AS hyp_speaker, sum(least(r.end_ms, h.end_ms) - greatest(r.start_ms, h.start_ms))::BIGINT AS overlap_ms FROM segments r JOIN turns h ON h.call_id = r.call_id AND greatest(r.start_ms, h.start_ms) < least(r.end_ms, h.end_ms) GROUP BY ALL)"

SQL = {
    "words_of_segments": sql(V.SEGMENTS, V.WORDS,
        "g AS (SELECT call_id, sequence, start_ms + 100 AS a, end_ms - 300 AS z, regexp_extract_all(raw_text, '\\S+') AS ws FROM segments)",
        "t AS (SELECT w.*, a, z, greatest(start_ms, a) AS t0, greatest(start_ms + 200, a) AS u0 FROM words w JOIN g USING (call_id, sequence) WHERE sequence % 5 <> 4)",
        "e AS (SELECT call_id, sequence, unnest(range(len(ws))) AS k, unnest(ws) AS word, a, z, greatest(greatest(z - a, 0) // len(ws), 50) AS part FROM g WHERE sequence % 5 = 4 AND len(ws) > 0)",
        body="SELECT call_id, sequence AS segment, row_number() OVER (PARTITION BY call_id, sequence ORDER BY pos) AS word_no, word, t0 AS start_ms, greatest(CASE WHEN length(word) > 3 THEN greatest(least(end_ms, z), u0 + 30) ELSE greatest(least(start_ms + 200, z), t0 + 30) END, t0 + 40) AS end_ms, CASE WHEN length(word) > 3 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence FROM t UNION ALL SELECT call_id, sequence, k, word, a + k * part, greatest(least(a + k * part + part, z), a + k * part + 40), 0.9 FROM e"),
    "words_of_tokens": sql(V.SEGMENTS, V.WORDS, body="SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY sequence, pos) AS word_no, word, start_ms, end_ms - CASE WHEN length(word) > 3 THEN 0 ELSE 200 END AS end_ms, CASE WHEN length(word) > 3 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence FROM words"),
    "counting_windows": sql(V.SEGMENTS, "t AS (SELECT call_id, sequence, start_ms, end_ms, CASE WHEN end_ms - 2000 <= start_ms THEN 0 ELSE (end_ms - 2000 - start_ms) // 1000 END AS k FROM segments)", "u AS (SELECT *, CASE WHEN end_ms - 2000 > start_ms AND start_ms + 1000 * k + 2000 < end_ms THEN k + 1 ELSE k END AS last FROM t)", 'v AS (SELECT call_id, sequence, end_ms, start_ms, unnest(range(last + 1)) AS "window" FROM u)', 'x AS (SELECT call_id, sequence, "window", start_ms + 1000 * "window" AS window_start, least(start_ms + 1000 * "window" + 2000, end_ms) AS window_end FROM v WHERE least(start_ms + 1000 * "window" + 2000, end_ms) - start_ms - 1000 * "window" > 50)', "y AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY window_start, window_end) - 1 AS r, count(*) OVER (PARTITION BY call_id) AS n FROM x)", body='SELECT call_id, sequence, "window", window_start, window_end FROM y WHERE r % ceil(n / 64)::BIGINT = 0'),
    "fixed_chunks": sql(V.CALLS, "t AS (SELECT id AS call_id, duration_ms, unnest(range((duration_ms + 9999) // 10000)) AS chunk FROM calls WHERE duration_ms > 0)", body="SELECT call_id, chunk, chunk * 10000 AS start_ms, least(duration_ms - chunk * 10000, 10000) AS real_ms FROM t"),
    "renumber_labels": sql(V.VOICE_PRINTS, "t AS (SELECT id, id // 40 AS call_id, label, min(id) OVER (PARTITION BY id // 40, label) AS f FROM voice_prints)", body="SELECT id, call_id, label, dense_rank() OVER (PARTITION BY call_id ORDER BY f) - 1 AS number FROM t"),
    "stereo_turns": sql(V.SEGMENTS, V.TURNS, body="SELECT call_id, speaker_id, start_ms, end_ms, row_number() OVER (PARTITION BY call_id ORDER BY start_ms, speaker_id) - 1 AS turn FROM turns WHERE speaker_id IN (0, 1)"),
    "valid_transcripts": sql(V.SEGMENTS, body="SELECT call_id, count(*) AS n_segments FROM segments GROUP BY 1 HAVING NOT bool_or(call_id % 10 = 3 AND sequence = 2)"),
    "segment_classes": sql(V.VOICE_PRINTS, "t AS (SELECT id, embedding[1:7] AS e, list_sort(list_transform(embedding[1:5], lambda x: floor(abs(x) * 10)::BIGINT)) AS m FROM voice_prints)", body="SELECT id, ['', '0', '1', '2', '0+1', '0+2', '1+2'][list_position(e, list_max(e))] AS speakers, greatest(m[3], 1) AS median FROM t"),
    "calendar_entities": sql(V.ANALYSES, _ENTITIES, body="SELECT call_id, CASE WHEN call_id % 4 IN (0, 3) THEN 'v' || call_id END AS place, call_id % 4 IN (0, 3) OR reason IS NOT NULL AS is_event, CASE call_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'error' ELSE 'waiting' END AS badge FROM ents"),
    "call_messages": sql(V.ANALYSES, _ENTITIES, body="SELECT call_id, concat_ws(chr(10) || chr(10), '*' || title || '*', CASE WHEN resolved THEN 'Resolved.' END, 'Reason: ' || reason, CASE WHEN call_id % 4 <> 1 THEN 'Details:' || chr(10) || '- ' || kind || ': v' || call_id END) AS message FROM ents"),
    "conversation_metrics": sql(V.SEGMENTS, _RUNS, body="SELECT a.*, am::BIGINT AS agent_monologue_ms, cm::BIGINT AS customer_monologue_ms, round(agent_ms / greatest(agent_ms + customer_ms, 1), 6) AS agent_ratio, round(customer_ms / greatest(agent_ms + customer_ms, 1), 6) AS customer_ratio, CASE WHEN agent_ms > 0 THEN round(agent_words * 60000.0 / agent_ms, 4) ELSE 0 END::DOUBLE AS agent_wpm, CASE WHEN customer_ms > 0 THEN round(customer_words * 60000.0 / customer_ms, 4) ELSE 0 END::DOUBLE AS customer_wpm FROM a JOIN l USING (call_id)"),
    "segment_words": sql(V.SEGMENTS, V.WORDS, _WORDS_SQL, _SEGMENTED, body="SELECT call_id, sequence::BIGINT AS sequence, arg_min(speaker_id, ordinal) AS speaker_id, arg_min(language, ordinal) AS language, min(start_ms) AS start_ms, arg_max(end_ms, ordinal) AS end_ms, count(*) AS n_words, string_agg(word, ' ' ORDER BY ordinal) AS text FROM s2 GROUP BY 1, 2"),
    "merge_turns": sql(V.SEGMENTS, V.TURNS, "t1 AS (SELECT *, CASE WHEN lag(speaker_id) OVER (PARTITION BY call_id ORDER BY start_ms, turn) = speaker_id THEN 0 ELSE 1 END AS ch FROM turns)", "t2 AS (SELECT *, sum(ch) OVER (PARTITION BY call_id ORDER BY start_ms, turn ROWS UNBOUNDED PRECEDING) AS run FROM t1)", "t3 AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY call_id, run ORDER BY start_ms, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2500 THEN 0 ELSE 1 END AS new FROM t2)", "t4 AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY start_ms, turn ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM t3)", body="SELECT call_id, part, min(speaker_id) AS speaker_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_turns FROM t4 GROUP BY 1, 2"),
    "merge_intervals": sql(V.SEGMENTS, "t1 AS (SELECT call_id, start_ms, end_ms, CASE WHEN greatest(start_ms - lag(end_ms) OVER (PARTITION BY call_id ORDER BY start_ms, end_ms), 0) <= 9000 AND lag(end_ms) OVER (PARTITION BY call_id ORDER BY start_ms, end_ms) IS NOT NULL THEN 0 ELSE 1 END AS new FROM segments WHERE speaker_id = 1)", "t2 AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING)::BIGINT AS region FROM t1)", "t3 AS (SELECT call_id, region, min(start_ms) AS s, max(end_ms) AS e FROM t2 GROUP BY 1, 2)", body="SELECT call_id, region, greatest(s - 100, 0) AS start_ms, e AS end_ms FROM t3 WHERE e - s >= 4000"),
    "sliding_windows": sql(V.SEGMENTS, "t AS (SELECT call_id, sequence, start_ms, end_ms, CASE WHEN end_ms - 800 <= start_ms THEN 0 ELSE (end_ms - 800 - start_ms) // 400 END AS k FROM segments)", "u AS (SELECT *, CASE WHEN end_ms - 800 > start_ms AND start_ms + 400 * k + 800 < end_ms THEN k + 1 ELSE k END AS last FROM t)", 'v AS (SELECT call_id, sequence, end_ms, start_ms, unnest(range(last + 1)) AS "window" FROM u)', body='SELECT call_id, sequence, "window", start_ms + 400 * "window" AS window_start, least(start_ms + 400 * "window" + 800, end_ms) AS window_end FROM v WHERE least(start_ms + 400 * "window" + 800, end_ms) - start_ms - 400 * "window" > 50'),
    "speaker_metadata": sql(V.SEGMENTS, body="SELECT call_id, speaker_id, arg_min(speaker_role, sequence) AS role, sum(end_ms - start_ms)::BIGINT AS talk_time_ms, sum(n_words)::BIGINT AS word_count FROM segments GROUP BY 1, 2"),
    "speaker_roles": sql(V.SEGMENTS, "t AS (SELECT call_id, speaker_id, sequence, row_number() OVER (PARTITION BY call_id ORDER BY sequence) AS r FROM segments)", "g AS (SELECT call_id, arg_min(speaker_id, r) FILTER (WHERE r <= 4 AND sequence = 1 AND call_id % 3 = 0) AS agent FROM t GROUP BY 1)", body="SELECT DISTINCT call_id, speaker_id, CASE WHEN agent IS NULL THEN CASE speaker_id WHEN 0 THEN 'agent' WHEN 1 THEN 'customer' ELSE 'unknown' END WHEN speaker_id = agent THEN 'agent' ELSE 'customer' END AS role FROM t JOIN g USING (call_id)"),
    "stereo_roles": sql(V.SEGMENTS, "g AS (SELECT call_id, bool_or(speaker_id = 1 AND call_id % 3 = 0) AS r FROM segments GROUP BY 1)", body="SELECT call_id, CASE WHEN r THEN 1 ELSE 0 END AS agent_speaker, CASE WHEN r THEN 0 ELSE 1 END AS customer_speaker FROM g"),
    "sentiment_trajectory": sql(V.SEGMENTS, V.ANALYSES, body="SELECT call_id, sequence, start_ms, sentiment_score::DOUBLE AS sentiment_score FROM segments JOIN analyses USING (call_id)"),
    "align_words_to_turns": sql(V.SEGMENTS, V.WORDS, V.TURNS, _ALIGN, body="SELECT call_id, sequence, pos, word, turn_speaker, coalesce(overlap_ms, 0) AS overlap_ms FROM p WHERE k = 1"),
    "der_overlap_matrix": sql(V.SEGMENTS, V.TURNS, _PAIRS, body="SELECT * FROM p"),
    "der_evaluation": sql(
        V.SEGMENTS, V.TURNS, _PAIRS, "o AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY overlap_ms DESC, ref_speaker, hyp_speaker) AS k FROM p)",
        """g(call_id, k, refs, hyps, ms) AS (SELECT DISTINCT call_id, 0::BIGINT, []::INTEGER[], []::INTEGER[], 0::BIGINT FROM p UNION ALL
          SELECT g.call_id, o.k, CASE WHEN NOT list_contains(refs, ref_speaker) AND NOT list_contains(hyps, hyp_speaker) THEN list_append(refs, ref_speaker) ELSE refs END,
            CASE WHEN NOT list_contains(refs, ref_speaker) AND NOT list_contains(hyps, hyp_speaker) THEN list_append(hyps, hyp_speaker) ELSE hyps END,
            ms + CASE WHEN NOT list_contains(refs, ref_speaker) AND NOT list_contains(hyps, hyp_speaker) THEN overlap_ms ELSE 0 END
          FROM g JOIN o ON o.call_id = g.call_id AND o.k = g.k + 1)""",
        "t AS (SELECT call_id, sum(end_ms - start_ms)::BIGINT AS r FROM segments GROUP BY 1)", "h AS (SELECT call_id, sum(end_ms - start_ms)::BIGINT AS h FROM turns GROUP BY 1)",
        "b AS (SELECT call_id, sum(overlap_ms)::BIGINT AS b FROM p GROUP BY 1)", "m AS (SELECT call_id, arg_max(ms, k) AS m FROM g GROUP BY 1)",
        "x AS (SELECT call_id, r, greatest(r - coalesce(b, 0), 0) AS missed_ms, greatest(coalesce(h, 0) - coalesce(b, 0), 0) AS false_ms, greatest(coalesce(b, 0) - coalesce(m, 0), 0) AS confused_ms FROM t LEFT JOIN h USING (call_id) LEFT JOIN b USING (call_id) LEFT JOIN m USING (call_id))",
        body="SELECT call_id, r AS reference_ms, missed_ms, false_ms, confused_ms, CASE WHEN r > 0 THEN round((missed_ms + false_ms + confused_ms) / r, 6) ELSE 0 END::DOUBLE AS der FROM x").replace("WITH ", "WITH RECURSIVE ", 1),
    "identify_speakers": sql(V.VOICE_PRINTS, f"p AS (SELECT a.id, b.id AS exemplar, b.name, {_COS} AS d FROM voice_prints a JOIN voice_prints b ON a.call_id % 5 = b.call_id % 5 AND a.id <> b.id WHERE a.name IS NULL AND b.name IS NOT NULL)", "q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, exemplar) AS r FROM p WHERE d <= 0.9)", body="SELECT id, exemplar, name, round(d, 6) AS distance FROM q WHERE r = 1"),
    "speaker_centroids": sql(V.VOICE_PRINTS, "t AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM voice_prints)", body="SELECT label, pos, round(avg(x), 5) AS x FROM t GROUP BY 1, 2"),
    "absorb_small_clusters": sql(
        V.VOICE_PRINTS, "r AS (SELECT id, id // 40 AS call_id, label, embedding, count(*) OVER (PARTITION BY id // 40, label) AS n FROM voice_prints)",
        "m AS (SELECT call_id, label, pos, avg(x) AS x FROM (SELECT call_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM r WHERE n >= 4) GROUP BY ALL)", "b AS (SELECT call_id, label, list(x ORDER BY pos) AS embedding FROM m GROUP BY ALL)",
        f"d AS (SELECT a.id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY {_COS}, b.label) AS k FROM r a JOIN b ON a.call_id = b.call_id WHERE a.n < 4)", body="SELECT r.id, r.call_id, coalesce(d.label, r.label) AS label FROM r LEFT JOIN d ON d.id = r.id AND k = 1"),
    "emotion_distribution": _emotions_sql(),
    "vad_frames": sql(_SAMPLES, _FRAMES, body="SELECT call_id, frame, round(energy, 6) AS energy, round(zcr, 6) AS zcr FROM frames"),
    "vad_regions": sql(_SAMPLES, _FRAMES, _VAD, body="SELECT call_id, region::BIGINT AS region, greatest(s - 100, 0) AS start_ms, least(e + 100, total) AS end_ms FROM r7 WHERE e - s >= 200"),
    "frame_runs": sql(_SAMPLES, _FRAMES, "q1 AS (SELECT *, CASE WHEN (frame - lag(frame) OVER (PARTITION BY call_id ORDER BY frame) - 1) * 30 < 60 THEN 0 ELSE 1 END AS new FROM frames WHERE zcr > 0.3)", "q2 AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY frame ROWS UNBOUNDED PRECEDING)::BIGINT AS region FROM q1)", body="SELECT call_id, region, min(frame) * 30 AS start_ms, (max(frame) + 1) * 30 AS end_ms FROM q2 GROUP BY 1, 2 HAVING (max(frame) + 1 - min(frame)) * 30 >= 90"),
    "channel_mode": sql(_SAMPLES, "t AS (SELECT call_id, sqrt(avg(x * x)) AS l, sqrt(avg(y * y)) AS r, corr(x, y) AS c, sqrt(greatest(var_pop(x) * var_pop(y), 0)) * count(*) AS s, avg(abs(x - y)) AS apart FROM samples GROUP BY 1)", "u AS (SELECT *, CASE WHEN s < 1e-6 THEN CASE WHEN apart < 1e-4 THEN 1.0 ELSE 0.0 END ELSE c END AS k FROM t)", body="SELECT call_id, round(l, 4) AS left_rms, round(r, 4) AS right_rms, round(k, 4)::DOUBLE AS correlation, CASE WHEN l < 0.001 OR r < 0.001 OR k > 0.85 THEN 'mixed' ELSE 'separated' END AS mode FROM u"),
    "window_language_vote": f"WITH {_VOTES} SELECT call_id, max(language) FILTER (WHERE r = 1) AS primary_language, max(p) FILTER (WHERE r = 1) AS confidence, coalesce(max(p) FILTER (WHERE r = 2) >= 0.15, false) AS is_mixed FROM k GROUP BY 1",
    "stt_route": f"WITH {_VOTES} SELECT call_id, CASE WHEN max(language) FILTER (WHERE r = 1) = 'he' AND NOT coalesce(max(p) FILTER (WHERE r = 2) >= 0.15, false) AND max(p) FILTER (WHERE r = 1) >= 0.9 THEN 'hebrew' ELSE 'multilingual' END AS route FROM k GROUP BY 1",
    "language_shares": sql(V.SEGMENTS, V.WORDS, _WORDS_SQL, body="SELECT call_id, language, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY call_id), 6) AS probability FROM w GROUP BY 1, 2"),
    "language_samples": sql(V.SEGMENTS, 't AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY start_ms, end_ms) AS "window" FROM segments)', body='SELECT call_id, "window", start_ms, least(end_ms, start_ms + 15000) AS end_ms FROM t WHERE "window" <= 4'),
    "mock_transcription": sql(V.CALLS, "t AS (SELECT id AS call_id, duration_ms, CASE id % 4 WHEN 0 THEN ['שלום', 'במה', 'אפשר', 'לעזור', 'לך', 'היום'] WHEN 1 THEN ['Здравствуйте', 'у', 'меня', 'вопрос', 'по', 'заказу'] WHEN 2 THEN ['Hello', 'how', 'can', 'I', 'help', 'you', 'today'] ELSE ['sample', 'transcription', 'word', 'stream'] END AS ws FROM calls WHERE duration_ms IS NOT NULL)", "u AS (SELECT call_id, duration_ms, greatest(duration_ms // len(ws), 200) AS step, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM t)", body="SELECT call_id, pos, word, pos * step AS start_ms, least((pos + 1) * step - 50, duration_ms) AS end_ms FROM u"),
    "plugin_results": r"SELECT doc_id AS call_id, 'word_count' AS plugin, len(regexp_extract_all(text, '\S+')) AS words FROM documents",
    "token_windows": """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
c AS (SELECT doc_id, pos, ceil((length(line) + 1) / 3)::BIGINT AS cost FROM l),
g(doc_id, pos, used, win, cost) AS (SELECT doc_id, pos, cost, 0, cost FROM c WHERE pos = 0 UNION ALL
  SELECT c.doc_id, c.pos, CASE WHEN used > 0 AND used + c.cost > 200 THEN c.cost ELSE used + c.cost END, win + CASE WHEN used > 0 AND used + c.cost > 200 THEN 1 ELSE 0 END, c.cost
  FROM g JOIN c ON c.doc_id = g.doc_id AND c.pos = g.pos + 1)
SELECT doc_id, win AS "window", count(*) AS n_lines, sum(cost)::BIGINT AS tokens, min(pos) AS first_line FROM g GROUP BY 1, 2""",
    "opening_text": sql(V.SEGMENTS, "t AS (SELECT call_id, sequence, trim(raw_text) AS t FROM segments WHERE trim(raw_text) <> '')", "b AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY call_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0) AS before FROM t)", "j AS (SELECT call_id, string_agg(t, ' ' ORDER BY sequence) AS t FROM b WHERE before < 280 GROUP BY 1)", body="SELECT call_id, CASE WHEN length(t) > 280 THEN left(t, 280) || '…' ELSE t END AS opening FROM j"),
    "prompt_lines": sql(V.SEGMENTS, "t AS (SELECT call_id, sequence, '[' || sequence || '] (' || lpad((start_ms // 60000)::VARCHAR, 2, '0') || ':' || lpad((start_ms % 60000 // 1000)::VARCHAR, 2, '0') || ') Speaker ' || CASE speaker_role WHEN 'agent' THEN 1 WHEN 'customer' THEN 2 WHEN 'supervisor' THEN 3 ELSE speaker_id + 1 END || ': ' || raw_text AS line FROM segments)", body="SELECT *, ceil(length(line) / 3)::BIGINT AS tokens FROM t"),
}
