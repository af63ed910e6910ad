"""Queries on tables that are larger than the given ones, or laid out differently."""

from pyspark.sql import functions as F

from parlance.operators import calls as C
from parlance.operators import index as I
from parlance.operators import ngrams as N
from parlance.operators import plugins
from parlance.operators import search as S
from parlance.operators import segmented as G
from parlance.plans import registry
from parlance.sources import views as V

from .compare import connection, rows
from .conftest import SF


def same(spark, name, folder):
    got = registry.QUERIES[name](spark, folder).toPandas()
    return rows(got) == rows(connection(folder).execute(registry.SQL[name]).fetchdf())


def test_calls_with_large_ids(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    more = orders.withColumn("o_orderkey", (F.col("o_orderkey") + 8_000_000).cast(orders.schema["o_orderkey"].dataType))
    orders.unionByName(more).toPandas().to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    assert same(spark, "create_calls", str(tmp_path))


def test_appended_calls_keep_the_old_ones(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, organization_id long, external_id string")
    old, new = frame([(1, 1, "a"), (2, 1, None)]), frame([(3, 1, "a"), (4, 2, "a"), (5, 1, None)])
    assert {r.id for r in C.created(old, new).collect()} == {4, 5}
    assert {r.id for r in C.appended_new(old, new).collect()} == {1, 2, 4, 5}


def brute_postings(rows):
    out = {}
    for key, text in rows:
        for pos, term in enumerate((text or "").split()):
            tf, first = out.get((key, term), (0, pos))
            out[key, term] = tf + 1, min(first, pos)
    return {(k, "text", t, *v) for (k, t), v in out.items()}


def test_postings_shuffle_texts_and_no_words(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_WORDS", 7)
    texts = [(i, " ".join(f"w{j * j % (i + 1)}" for j in range(i))) for i in range(40)] + [(100, None), (101, "")]
    got = S.postings(spark.createDataFrame(texts, "call_id long, text string"), ("text",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    assert {tuple(r) for r in got.collect()} == brute_postings(texts)
    again = [*texts, (39, "w0 new w0"), (None, "x"), (None, "y x")]
    got = S.postings(spark.createDataFrame(again, "call_id long, text string"), ("text",))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_postings(again)))


def test_index_postings_are_made_of_stored_entries(spark, tmp_path):
    index = G.Segmented(spark, str(tmp_path))
    entry = lambda i, text: (i, 0, "t", "s", text, "", "", "", "")
    schema = "call_id long, organization_id long, title string, summary string, transcript string, topics string, entities string, reason string, resolution string"
    index.replaced(spark.createDataFrame([entry(1, "b a b"), entry(2, "c"), entry(2, "d d")], schema))
    got = {(r.call_id, r.term, tuple(r.positions), r.dl) for r in index.postings().where("column = 'transcript'").collect()}
    assert got == {(1, "a", (1,), 5), (1, "b", (0, 2), 5), (2, "d", (0, 1), 4)} and index.manifest()["entries"] == 2
    plan = index.page(spark.createDataFrame([(1, None)], "id long, created_at timestamp_ntz"), "b")._jdf.queryExecution().toString()
    assert "EqualTo(call_id,1)" in plan


def test_ids_of_an_index_are_read_without_texts(spark):
    lengths = I.built(I.entries(V.index_rows(spark, SF))).lengths
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan(lengths.select("call_id", "organization_id").distinct())


def test_plugins_hold_few_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(plugins, "ROWS", 2)
    texts = spark.createDataFrame([(i, "a " * i if i else None) for i in range(7)], "call_id long, text string")
    got = plugins.run_plugins(texts, ["word_count"])
    assert {(r.call_id, r.payload) for r in got.collect() if r.call_id} == {(i, f'{{"words": {i}}}') for i in range(1, 7)}
    assert [r.error[:14] for r in got.where("payload IS NULL").collect()] == ["AttributeError"]
    assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_profiles_count_words_that_repeat(spark):
    texts = [("a", "ab abc ab"), ("a", "ab Zed"), ("b", "zed")]
    known = N.profiles(spark.createDataFrame(texts, "l string, t string").coalesce(1), "t", "l")
    assert known == {lang: N.ranked(N.trigrams(" ".join(t for k, t in texts if k == lang)), 300) for lang in "ab"}


def test_postings_are_looked_at_once(spark, tmp_path):
    index = G.Segmented(spark, str(tmp_path))
    entry = lambda i, text: (i, 0, "t", "s", text, "", "", "", "")
    rows = lambda *r: spark.createDataFrame(list(r), "call_id long, organization_id long, title string, summary string, transcript string, topics string, entities string, reason string, resolution string")
    index.replaced(rows(*[entry(i, f"old{i} x") for i in range(20)]))
    index.replaced(rows(entry(3, "new x")))
    index.retitled(spark.createDataFrame([(3, "later"), (4, "later")], "call_id long, title string"))
    got = index.postings()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("positions:array<int>") == 1 and "Union" not in plan
    found = {(r.call_id, r.column, r.term) for r in got.where("call_id in (3, 4)").collect()}
    assert found == {(3, "title", "later"), (4, "title", "later"), (3, "summary", "s"), (4, "summary", "s"), (3, "transcript", "new"), (3, "transcript", "x"), (4, "transcript", "old4"), (4, "transcript", "x")}


def test_words_over_all_letters_of_a_batch(spark):
    letters = ["a", "B", "é", "É", "ü", "İ", "ı", "Σ", "ς", " ", "_", "x1", "２", "Ⅻ", "e\u0301", "\u0345", "\u0870", "\U0001f600", "\U00010400", "日", "\0", "\n"]
    texts = [(i, "".join(letters[(i * k + k * k) % len(letters)] for k in range(i % 40))) for i in range(400)]
    rows = spark.createDataFrame([*texts, (999, None)], "call_id long, text string")
    got = {(r.call_id, r.term, tuple(r.positions)) for r in S.occurrences(rows, ("call_id",), ("text",)).collect()}
    flat = rows.select("call_id", F.posexplode(S.terms_of(F.col("text"))).alias("pos", "term")).groupBy("call_id", "term").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    assert got == {(r.call_id, r.term, tuple(r.p)) for r in flat.collect()}
    assert rows.where(S.n_words(F.col("text")) != F.size(S.terms_of(F.col("text")))).count() == 0


def test_a_calls_tokens_stay_together(spark):
    plan = registry.QUERIES["words_of_tokens"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan


def test_metadata_is_dealt_out_by_rows(spark, monkeypatch):
    from parlance.operators import records as R

    monkeypatch.setattr(R, "ROWS_A_TASK", 1000, raising=False)
    got = registry.QUERIES["set_audio_metadata"](spark, SF)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert same(spark, "set_audio_metadata", SF)
