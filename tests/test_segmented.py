"""The segmented index: updates of its own size, searches like a rebuilt index's, covers and snippets by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.operators import index as I
from parlance.operators import segmented as G
from parlance.operators.calls import DisplayFilter
from parlance.sources import publish

WORDS = "alpha alphabet beta gamma delta omega café".split()
SCHEMA = "call_id long, organization_id long, title string, summary string, transcript string, topics string, entities string, reason string, resolution string"


def entry(rng, i, transcript=None, title=None):
    text = lambda n: " ".join(rng.choice(WORDS + ["x", "y", "z"]) for _ in range(n))
    return (i, i % 3, title or text(4), text(6), transcript or text(rng.randrange(60)), "t", "", "", "")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """An index after many changes, and the rows that it should have."""
    rng, index = random.Random(5), G.Segmented(spark, str(tmp_path_factory.mktemp("index")))
    rows = {i: entry(rng, i) for i in range(200)}
    index.replaced(frame(spark, list(rows.values())))
    sizes = []
    for step in range(4):
        new = {i: entry(rng, i) for i in rng.sample(range(220), 3)}
        rows |= new
        sizes.append(index.replaced(frame(spark, list(new.values())))["postings"])
        titles = {i: f"beta omega {step}" for i in rng.sample(sorted(rows), 3)}
        rows |= {i: (*rows[i][:2], t, *rows[i][3:]) for i, t in titles.items()}
        index.retitled(spark.createDataFrame([*titles.items(), (999, "not there")], "call_id long, title string"))
    gone = [*rng.sample(sorted(rows), 5), 998]
    index.without(spark.createDataFrame([(i,) for i in gone], "call_id long"))
    return index, {i: r for i, r in rows.items() if i not in gone}, sizes


def scores(df):
    return {r.call_id: round(r.score, 9) for r in df.collect()}


QUERIES = ("alpha", "beta omega", "CAFE* gam", "zzz", " *() ")


def check(spark, index, rows):
    rebuilt = I.built(I.entries(frame(spark, list(rows.values()))))
    for q in QUERIES:
        assert scores(index.ranked(q)) == scores(rebuilt.ranked(q)) and {r.call_id for r in index.matches(q).collect()} == {r.call_id for r in rebuilt.matches(q).collect()}
    known = index.manifest()
    assert known["entries"] == len(rows) == index.entries().count()
    assert known["words"] == index.entries().agg(F.sum("dl")).first()[0] == rebuilt.lengths.agg(F.sum("n")).first()[0]


def test_searches_equal_a_rebuilt_index(spark, filled):
    index, rows, sizes = filled
    check(spark, index, rows)
    assert max(sizes) * 20 < index.postings().count()  # 3 of 200 entries


def test_merging(spark, filled):
    index, rows, _ = filled
    before = index.manifest()
    assert index.merged(most=100) is None
    index.merged(most=3)
    after = index.manifest()
    assert len(before["segments"]) == 10 and 1 < len(after["segments"]) < 5 and after["segments"][0] == before["segments"][0]
    check(spark, index, rows)
    index.merged(most=1, growth=10**9)
    assert len(index.manifest()["segments"]) == 1
    check(spark, index, rows)


def test_of_two_writers_one_tries_again(spark, tmp_path):
    a = G.Segmented(spark, str(tmp_path))
    known = a.manifest()
    a.replaced(frame(spark, [entry(random.Random(1), 1)]))
    with pytest.raises(G.Conflict):
        a._publish(known, [], 0, 0)
    assert a.manifest()["entries"] == 1 and publish.names(spark, f"{tmp_path}/manifest") == ["v000000001.json"]


def test_postings_are_pruned_by_term(spark, filled):
    plan = filled[0].hits("alpha")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(term,alpha\)", plan)


def brute_covers(words, prefixes):
    """Stretches that meet all prefixes and of which no part does."""
    ok = lambda a, b: all(any(w.startswith(p) for w in words[a : b + 1]) for p in prefixes)
    return {(a, b, sum(any(w.startswith(p) for p in prefixes) for w in words[a : b + 1])) for a in range(len(words)) for b in range(a, len(words)) if ok(a, b) and not ok(a + 1, b) and not ok(a, b - 1)}


def test_covers(spark, tmp_path):
    rng, index = random.Random(9), G.Segmented(spark, str(tmp_path))
    rows = [(i, 0, "", "", " ".join(rng.choice("alpha beta gamma x y z w".split()) for _ in range(rng.randrange(40))), "", "", "", "") for i in range(40)]
    index.replaced(frame(spark, rows))
    for q in ("alpha beta", "alpha beta gamma", "alpha", "al alpha"):
        want = {(r[0], *c) for r in rows for c in brute_covers(r[4].split(), list(dict.fromkeys(q.split())))}
        assert {(r.call_id, r.first, r.last, r.hits) for r in index.covers(q).collect()} == want
        dense = {}
        for i, a, b, n in want:
            dense[i] = dense.get(i, 0) + G.WEIGHT / (1 + b - a + 1 - n)
        got = scores(index.rank_by_covers(q))
        assert got.keys() == dense.keys() and all(abs(got[i] - dense[i]) < 1e-6 for i in dense)


def test_frequency_rank(spark, tmp_path):
    index = G.Segmented(spark, str(tmp_path))
    index.replaced(frame(spark, [(1, 0, "alpha", "", "alpha alphabet x", "", "", "", ""), (2, 0, "", "", " ".join(["alpha"] * 300), "", "", "", "")]))
    got = scores(index.rank_by_frequency("alpha nothing"))
    assert abs(got[1] - 0.1 * (1 + 1 / 4 + 1) / 1.64493406685 / 2) < 1e-9
    assert abs(got[2] - 0.1 * sum(1 / k**2 for k in range(1, 257)) / 1.64493406685 / 2) < 1e-9


def test_snippets(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["Alpha,", "beta", *"abcdefghijkl"]) for _ in range(rng.randrange(60)))) for i in range(60)] + [(100, None), (101, ""), (102, "alpha " + "x " * 40 + "alpha y alpha z alpha")]
    got = {r.call_id: r for r in G.snippets(spark.createDataFrame(texts, "call_id long, text string"), "alpha", 8).collect()}
    for i, text in texts:
        ws = (text or "").split()
        hits = [k for k, w in enumerate(ws) if w.lower().startswith("alpha")]
        if not hits:
            assert i not in got
            continue
        counts = {k: sum(k <= h < k + 8 for h in hits) for k in hits}
        best = min(k for k in hits if counts[k] == max(counts.values()))
        start = max(min(best, len(ws) - 8), 0)
        cut = " ".join(f"<b>{w}</b>" if k in hits else w for k, w in enumerate(ws[start : start + 8], start))
        assert got[i].snippet == "..." * (start > 0) + cut + "..." * (start + 8 < len(ws)) and got[i].n_hits == max(counts.values())
    assert got[102].snippet.count("<b>") == 3


def test_page_display_and_question(spark, tmp_path):
    index = G.Segmented(spark, str(tmp_path))
    index.replaced(frame(spark, [(1, 0, "First", "One sum.", "parcel late parcel", "", "", "", ""), (2, 0, "Second", "Two sum.", "a parcel", "", "", "", ""), (3, 0, "Third", "", "nothing", "", "", "", "")]))
    index.retitled(spark.createDataFrame([(2, "Renamed")], "call_id long, title string"))
    calls = spark.createDataFrame([(i, f"ext-{i}", "completed", i == 2, f"2024-01-0{i}") for i in (1, 2, 3)], "id long, external_id string, status string, is_favorite boolean, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    page = index.page(calls, "parcel").orderBy(F.desc("score")).collect()
    assert [(r.call_id, r.title, r.snippet) for r in page] == [(1, "First", "<b>parcel</b> late <b>parcel</b>"), (2, "Renamed", "a <b>parcel</b>")]
    asked = G.asked(index, calls, "parcel?").first()
    assert asked.context == "Source [1]: Call ID: 1\nTitle: First\nSummary: One sum.\nExcerpt: <b>parcel</b> late <b>parcel</b>\n\nSource [2]: Call ID: 2\nTitle: Renamed\nSummary: Two sum.\nExcerpt: a <b>parcel</b>\n\n"
    assert asked.answer.startswith("Found 2 relevant") and [c.call_id for c in asked.citations] == [1, 2]
    assert G.asked(index, calls, "zebra").first().answer == G.NOTHING
    languages = spark.createDataFrame([(1, "en")], "call_id long, primary_language string")
    rows, total = index.display(calls, languages, DisplayFilter(text="parcel", limit=1), "2024-02-01 00:00:00")
    assert [r.id for r in rows.collect()] == [2] and total.first().total == 2
    assert index.display(calls, languages, DisplayFilter(text="ext-3"), "2024-02-01 00:00:00")[1].first().total == 1
