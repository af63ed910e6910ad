"""Texts that are made to fit, packing, and heartbeats, against plain Python."""

import pytest

from parlance.operators import conversation, queue, stages

from .conftest import SF


class Model:
    def __init__(self, answer):
        self.answer, self.asked = answer, []

    def complete(self, prompt):
        self.asked.append(prompt)
        return self.answer(prompt)


LINES = "".join(f"line {i} of a call\n" for i in range(40))


def test_a_text_that_fits_is_left_alone():
    m = Model(str.upper)
    assert stages.fitted("short", 2, m) == "short" and stages.fitted(LINES, 0, m) == LINES and not m.asked


def test_every_window_is_compressed():
    m = Model(lambda p: p.split("\n")[0] + " ")
    out = stages.fitted(LINES, 60, m)
    assert "".join(m.asked) == LINES and out == "".join(w.split("\n")[0] + "\n" for w in m.asked) and -(-len(out) // 3) <= 60


def test_no_progress_leaves_the_first_window():
    m = Model(lambda p: p)
    out = stages.fitted(LINES, 50, m)
    assert LINES.startswith(out) and 0 < -(-len(out) // 3) <= 50 and len(m.asked) == len(stages._windows(LINES, 50))


def test_a_failing_model_loses_no_window():
    def fails(prompt):
        if "line 0 " in prompt:
            raise ValueError("no")
        return "x"

    assert "line 0 of a call" in stages.fitted(LINES, 60, Model(fails))


def test_rounds_are_bounded():
    m = Model(lambda p: p[:-2])
    assert -(-len(stages.fitted(LINES, 40, m)) // 3) <= 40 and len(m.asked) <= stages.ROUNDS * len(LINES)


@pytest.mark.parametrize("costs, want", [([], []), ([9], [0]), ([3, 3, 4, 1], [0, 0, 0, 1]), ([2, 50, 1], [0, 1, 2]), ([10, 10], [0, 1])])
def test_window_numbers(costs, want):
    assert conversation.window_numbers(costs, 10) == want


def test_compressed_texts_fit(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = spark.createDataFrame([(1, None), (2, ""), *[(i + 3, t) for i, t in texts.items()]], "call_id bigint, text string")
    from parlance.plans.stages import FirstWords

    got = {r.call_id: r.text for r in stages.compressed(rows, 120, FirstWords()).collect()}
    assert got == {1: "", 2: "", **{i + 3: stages.fitted(t, 120, FirstWords()) for i, t in texts.items()}}
    assert any(got[i + 3] != t for i, t in texts.items())


def test_no_classifier_gives_no_row(spark):
    texts = spark.createDataFrame([(1, "cancel"), (2, None)], "call_id bigint, text string")
    assert stages.classified(texts, [stages.Classifier("Mood", "enum")]).count() == 0
    assert {(r.call_id, r.value) for r in stages.classified(texts, [stages.Classifier("cancellation")]).collect()} == {(1, True), (2, False)}


def test_a_second_fan_out_adds_nothing(spark):
    calls = spark.createDataFrame([(1,), (2,)], "id bigint")
    jobs = spark.createDataFrame([(7, 1, "a", None)], "id bigint, call_id bigint, kind string, run_after timestamp_ntz")
    once = stages.plugin_jobs(calls, jobs, ["a", "b"], "2024-02-01 00:00:00")
    assert sorted((r.call_id, r.kind) for r in once.collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert stages.plugin_jobs(calls, once, ["a", "b"], "2024-02-01 00:00:00").count() == 4


def test_heartbeat():
    assert [queue.heartbeat_seconds(x) for x in (3600, 9, 16)] == [1200, 5, 5]


def test_clustered_turns(spark):
    """A hint of speakers, the default of two, one region, one speaker."""
    import numpy as np

    from parlance.operators import acoustics, clustering

    rng = np.random.default_rng(3)
    x = {call: [(np.eye(8)[rng.integers(0, 3)] + 0.05 * rng.random(8)).tolist() for _ in range(12)] for call in (1, 2, 3, 4)}
    rows = [(call, i, 400 * i, 400 * i + 800, v) for call, vs in x.items() for i, v in enumerate(vs)]
    windows = spark.createDataFrame(rows, "call_id bigint, id bigint, window_start bigint, window_end bigint, embedding array<double>")
    regions = spark.createDataFrame([(c, 2600 * k, 2600 * k + 2400) for c in (1, 2, 3) for k in (0, 1)] + [(4, 0, 5200)], "call_id bigint, start_ms bigint, end_ms bigint")
    hints = spark.createDataFrame([(1, 9), (3, 1), (4, 3)], "call_id bigint, speakers int")
    got: dict = {}
    for r in sorted(acoustics.clustered_turns(regions, windows, hints).collect(), key=lambda r: (r.call_id, r.start_ms)):
        got.setdefault(r.call_id, []).append((r.speaker_id, r.start_ms, r.end_ms))
    want = {3: [(0, 0, 2400), (0, 2600, 5000)], 4: [(0, 0, 5200)]}
    for call, k in ((1, 4), (2, 2)):
        turns: list = []
        for i, c in enumerate(clustering.clustered(np.array(x[call]), None, k)):
            if turns and turns[-1][0] == c:
                turns[-1] = (c, turns[-1][1], 400 * i + 800)
            else:
                turns.append((c, 400 * i, 400 * i + 800))
        want[call] = turns
    assert got == want


@pytest.mark.parametrize("text, language", [("مرحبا بالعالم", "ar"), ("سلام چطوری", "he"), ("שלום", "he"), ("Bonjour à tous", "en"), ("مرحبا hello hello", "en"), ("", "unknown")])
def test_language_by_script(spark, text, language):
    from pyspark.sql import functions as F

    from parlance.functions.text import script_language

    assert spark.createDataFrame([(text,)], "t string").select(script_language(F.col("t"))).first()[0] == language


def test_marks_are_folded_alike_in_texts_and_queries(spark):
    from parlance.operators import search

    words = ["Ångström", "naïve", "Việt", "мой", "cafe\u0301", "ŻÓŁĆ", "שלום"]
    rows = spark.createDataFrame(list(enumerate(words)), "call_id bigint, t string")
    assert [r.x for r in rows.orderBy("call_id").select(search.folded(rows.t).alias("x")).collect()] == ["angstrom", "naive", "viet", "мой", "cafe", "zołc", "שלום"]
    for i, w in enumerate(words):
        assert [r.call_id for r in search.matches(rows, w, ("t",)).collect()] == [i]
