"""Scalars and operators on small literal inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import emotions, lenient, vectors
from parlance.functions import text as T
from parlance.operators import calls, clustering, conversation, exports, joins, queue, search, signal
from parlance.sources import files, headers


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [
    ("  20 dollars \n now ", "20 $ now"), ("100 שקלים", "100 ₪"), ("5 דולרים", "5 $ים"), ("10 руб. ok", "10 ₽ ok"),
    ("call 0501234567", "call 050-123-4567"), ("0601234567", "0601234567"), ("", ""), ("a b", "a b"),
])
def test_normalised(spark, text, want):
    assert one(spark, T.normalised(F.col("t")), t=text) == want


def test_scripts(spark):
    assert one(spark, T.script_language(F.col("t")), t="שלום עולם abc") == "he"
    assert one(spark, T.script_language(F.col("t")), t="Привет") == "ru"
    assert one(spark, T.script_language(F.col("t")), t="123") == "unknown"
    assert one(spark, T.direction(F.col("t"), F.lit("fr")), t="שלום a") == "rtl"
    assert one(spark, T.direction(F.col("t"), F.lit("en")), t="שלום") == "ltr"
    assert one(spark, T.has_foreign_script(F.col("t")), t="漢字漢 abc") is True
    assert one(spark, T.is_degenerate(F.col("t")), t="no no, No no! no no") is True


def test_file_names(spark):
    got = one(spark, T.parsed_filename(F.col("t")), t="Call recording Ann_Lee_250820_142338.m4a")
    assert (got.contact, got.phone, str(got.started_at)) == ("Ann_Lee", None, "2025-08-20 14:23:38")
    got = one(spark, T.parsed_filename(F.col("t")), t="Call +972500000000_260705_142254.m4a")
    assert (got.contact, got.phone) == (None, "+972500000000")
    assert one(spark, T.parsed_filename(F.col("t")), t="x_991399_000000.wav").started_at is None


def test_queries_of_the_box():
    assert T.query_terms('a "b*') == ["a", "b"]
    assert T.query_terms("שלום")[:2] == ["שלום", "השלום"]
    assert T.fts5_query("a b") == '"a"* OR "b"*'
    assert T.tsquery("") == ""


def test_emotions(spark):
    shares, dominant = emotions.distribution({e: emotions.hits(F.col("t"), F.lit("en"), e) for e in emotions.EMOTIONS})
    row = spark.range(1).select(F.lit("Thanks, I am mad").alias("t")).select(*[c.alias(e) for e, c in shares.items()], dominant.alias("dominant")).first()
    assert (round(row.joy, 4), round(row.anger, 4), row.dominant) == (0.6667, 0.3333, "joy")
    assert round(row.neutral, 4) == 0.4


def test_lenient():
    assert lenient.prose(["a.", "b", "none", {"x": 1}]) == "a. b; 1"
    assert lenient.prose([]) is None


def test_blobs():
    assert vectors.from_blob(vectors.to_blob([0.5, -1.0]) + b"x") == [0.5, -1.0]


def test_metrics_of_nothing_and_silence(spark):
    schema = "call_id long, sequence long, speaker_id int, speaker_role string, start_ms long, end_ms long, n_words long, raw_text string"
    rows = [(1, 0, 0, "agent", 600, 1600, 5, "hi"), (1, 1, 1, "customer", 2000, 3000, 4, "yo"), (1, 2, 1, "customer", 3600, 4600, 2, "x"), (1, 3, 2, "other", 4600, 5000, 1, "z")]
    got = conversation.conversation_metrics(spark.createDataFrame(rows, schema)).first()
    assert (got.silence_ms, got.speaker_switches, got.customer_monologue_ms, got.duration_ms) == (1200, 2, 2000, 5000)
    assert conversation.conversation_metrics(spark.createDataFrame([], schema)).count() == 0
    assert exports.srt(spark.createDataFrame(rows[:1], schema)).first().srt == "1\n00:00:00,600 --> 00:00:01,600\n[Speaker 1] hi\n\n"


def test_merge_equals_a_fold(spark):
    rng = np.random.default_rng(3)
    starts = np.cumsum(rng.integers(0, 400, 60))
    turns = [(1, i, int(rng.integers(0, 2)), int(s), int(s + rng.integers(50, 900))) for i, s in enumerate(starts)]
    want = []
    for _, _, who, s, e in turns:
        if want and want[-1][0] == who and s <= want[-1][2] + 200:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([who, s, e])
    df = spark.createDataFrame(turns, "call_id long, turn long, speaker_id int, start_ms long, end_ms long")
    got = conversation.merged_turns(df).orderBy("part").collect()
    assert [[r.speaker_id, r.start_ms, r.end_ms] for r in got] == want


def test_vectors(spark):
    d = lambda a, b: one(spark, joins.cosine_distance(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert d([1.0, 0.0], [0.0, 2.0]) == 1.0
    assert d([1.0, 0.0], [3.0, 0.0]) == 0.0
    assert d([0.0, 0.0], [1.0, 0.0]) == 1.0
    assert d([1.0], [1.0, 0.0]) == 1.0


def naive_average_linkage(x, threshold):
    d = clustering.distances(x)
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        pairs = [(np.mean([d[i, j] for i in a for j in b]), p, q) for p, a in enumerate(groups) for q, b in enumerate(groups) if p < q]
        best = min(pairs)
        if best[0] > threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    label = {i: min(g) for g in groups for i in g}
    names = {}
    return [names.setdefault(label[i], len(names)) for i in range(len(x))]


def test_clustering():
    rng = np.random.default_rng(5)
    for n in (2, 7, 20):
        x = rng.normal(size=(n, 6))
        for t in (0.3, 0.8, 1.1):
            assert clustering.clustered(x, t) == naive_average_linkage(x, t)
    centers = np.eye(16)[:3]
    x = np.repeat(centers, 8, 0) + rng.normal(scale=0.01, size=(24, 16))
    assert clustering.eigengap(x) == 3
    assert len(set(clustering.clustered(x, None, 2))) == 2


def test_signals():
    t = np.arange(16_000) / 16_000
    tone = np.sin(2 * np.pi * 200 * t)
    assert abs(signal.pitch(tone[:1600]) - 200) < 5
    assert signal.log_mel(tone).shape[1] == 80
    assert abs(np.linalg.norm(signal.voice_embedding(tone)) - 1) < 1e-9
    assert abs(len(signal.resampled(tone, 44_100)) - round(16_000 * 16_000 / 44_100)) <= 1
    x, rate, channels = signal.wav_samples(signal.wav_bytes(tone, 8000))
    assert (rate, channels) == (8000, 1) and np.abs(x - tone).max() < 1e-3
    assert signal.is_ogg_opus(b"OggS....OpusHead") and not signal.is_ogg_opus(b"RIFF")


def test_channel_modes(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=500), rng.normal(size=500)
    rows = [("same", float(x), float(x)) for x in a] + [("apart", float(x), float(y)) for x, y in zip(a, b)] + [("silent", float(x), 0.0) for x in a]
    got = {r.k: r["mode"] for r in signal.channel_modes(spark.createDataFrame(rows, "k string, x double, y double"), "k").collect()}
    assert got == {"same": "mixed", "apart": "separated", "silent": "mixed"}


def test_queue(spark):
    schema = "id long, call_id long, kind string, status string, priority long, attempt long, max_attempts long, run_after timestamp_ntz, locked_at timestamp_ntz, locked_by string, last_error string, created_at timestamp_ntz"
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([(1, 1, "a", "pending", 0, 0, 2, t, None, None, None, t), (2, 2, "b", "pending", 5, 2, 2, t, None, None, None, t), (3, 3, "a", "running", 0, 1, 3, t, t, "w9", None, t)], schema)
    got = queue.leased(jobs, "2024-01-02 00:00:00", ["w1", "w2"]).collect()
    assert [(r.id, r.attempt, r.locked_by, r.status) for r in got] == [(1, 1, "w1", "running")]
    assert queue.released(jobs, "2024-01-02 00:00:00", 3600).where("id = 3").first().status == "pending"
    assert queue.released(jobs, "2024-01-01 00:30:00", 3600).where("id = 3").first().status == "running"
    assert queue.renewed(jobs, 3, "w1", "2024-01-02 00:00:00").where("id = 3").first().locked_at == t
    assert queue.requeued(jobs, F.col("id") == 3).where("id = 3").first().attempt == 0


def test_pages():
    assert calls.page_of(3, 20, 41) == (40, 20, 3)
    assert calls.page_of(0, 5, 0) == (0, 10, 1)


def test_search(spark):
    docs = spark.createDataFrame([(1, "Résumé plan", "one delivery of many words that follow here"), (2, "delivery", "delivery delivery"), (3, "x", None)], "call_id long, title string, transcript string")
    hits = search.bm25(docs, "deliv", ("title", "transcript")).orderBy(F.desc("score")).collect()
    assert [r.call_id for r in hits] == [2, 1]
    assert [r.call_id for r in search.matches(docs, "resume", ("title",)).collect()] == [1]
    assert search.matches(docs, ' "* ', ("title",)).count() == 0
    got = docs.select(search.snippet(F.col("transcript"), "deliv", 2).alias("s")).collect()
    assert got[0].s == "one <b>delivery</b> of many"


def test_files(spark, tmp_path):
    (tmp_path / "Call Ann_250820_142338.wav").write_bytes(signal.wav_bytes(np.zeros(8000), 8000))
    (tmp_path / "notes.txt").write_text("x")
    found = files.recordings(spark, str(tmp_path))
    assert [(r.external_id, r.mime_type, r.parsed.contact) for r in found.collect()] == [("Call Ann_250820_142338.wav", "audio/wav", "Ann")]
    assert headers.headers(spark, str(tmp_path)).first().duration_ms == 1000
    none = spark.createDataFrame([], "external_id string")
    assert files.import_summary(found, files.new_recordings(found, none)).first().asDict() == {"found": 1, "imported": 1, "skipped": 0}
    assert files.safe_key("../a//b/..") == "a/b"


def test_shapes(spark):
    from parlance.functions import answers

    rows = spark.createDataFrame([('{"a": 1, "b": [], "c": null, "d": {}, "e": "x", "f": true}',), ("[1]",), ("no json",), (None,)], "t string")
    assert [r[0] for r in rows.select(answers.shape(F.col("t"))).collect()] == ["a=number b=array c=null d=object e=string f=bool", None, None, None]


def test_accepted_answers(spark):
    from parlance.functions import answers

    rows = spark.createDataFrame([("Customer Service Call", "It was neither nor."), ("Refund", "no no no no"), (None, None), ("漢字漢字", "Fine."), ("A call", "A misunderstandings, and so on")], "t string, s string")
    got = rows.select(answers.accepted_title(F.col("t"), F.lit("T")), answers.accepted_summary(F.col("s"), F.lit("S"))).collect()
    assert [tuple(r) for r in got] == [("T", "S"), ("Refund", "S"), ("T", "S"), ("T", "Fine."), ("A call", "S")]


def test_writes_that_name_no_row(spark):
    from parlance.operators import records

    calls = spark.createDataFrame([(1, "[]")], "id long, tags string")
    voices = spark.createDataFrame([(1, 0, None)], "call_id long, speaker_id int, name string")
    with pytest.raises(records.NotFound):
        records.set_tags(calls, 2, ["a"])
    with pytest.raises(records.NotFound):
        records.name_voice(voices, 1, 1, "Ann")
    assert records.name_voice(voices, 1, 0, "Ann").first().name == "Ann"


def test_turns_of_regions(spark):
    from parlance.operators import acoustics

    regions = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 20, 30), (2, 0, 5, 9)], "call_id long, region int, start_ms long, end_ms long")
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 3)], "call_id long, region int, label int")
    calls = spark.createDataFrame([(1, 40), (2, 40), (3, 40)], "call_id long, duration_ms long")
    got = acoustics.turns_of_regions(regions, labels, calls).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 0, 10), (1, 2, 20, 30), (2, 0, 5, 9), (3, 0, 0, 40)]


def test_exemplars_in_parts(spark, monkeypatch):
    from parlance.operators import joins

    rows = spark.createDataFrame([(k, k % 2, f"n{k}" if k % 3 == 0 else None, [float(k % 5), float(k % 7), 1.0]) for k in range(40)] + [(50, 0, None, [0.0, 0.0, 0.0])], "id long, organization_id int, name string, embedding array<double>")
    whole = joins.identified(rows.where("name IS NULL"), rows).collect()
    monkeypatch.setattr(joins, "FEW_NUMBERS", 7)
    assert sorted(joins.identified(rows.where("name IS NULL"), rows).collect()) == sorted(whole) and whole


def test_index_of_hebrew_words(spark):
    from parlance.operators import index

    rows = spark.createDataFrame([(1, 1, "הפגישה מחר", None), (2, 1, "פגישה", ["a", "b"]), (3, 1, "other", [])], "call_id long, organization_id long, title string, topics array<string>")
    rows = rows.selectExpr("*", "CAST(NULL AS string) AS summary", "'' AS transcript", "CAST(NULL AS array<string>) AS entities", "CAST(NULL AS string) AS reason", "'' AS resolution")
    built = index.built(index.entries(rows))
    assert sorted(r.call_id for r in built.matches("פגישה").collect()) == [1, 2]
    assert built.matches(" ").isEmpty() and built.without(rows.where("call_id = 1")).matches("מחר").isEmpty()
    again = built.retitled(spark.createDataFrame([(3, "פגישה"), (9, "x")], "call_id long, title string"))
    assert sorted(r.call_id for r in again.matches("פגישה").collect()) == [1, 2, 3] and again.matches("x").isEmpty()
