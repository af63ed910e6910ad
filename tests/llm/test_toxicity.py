"""The classifier: optimal weights, accuracy on rows never learnt from, group mentions, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import toxicity
from parlance.llm.queries import QUERIES
from tests.conftest import SF

from .helpers import ODD, clashing, frame, own


def auc(scores, labels):
    pos = [s for s, y in zip(scores, labels, strict=True) if y]
    neg = [s for s, y in zip(scores, labels, strict=True) if not y]
    return np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])


def test_solved_is_optimal():
    """At the optimum the gradient is within the penalty, and equals it where a weight isn't 0."""
    rng = random.Random(1)
    rows = [sorted(rng.sample(range(30), 6)) for _ in range(200)]
    y = [int((3 in r) + (7 in r) + rng.random() * 0.8 > 1) for r in rows]
    pairs = [([3], [4]), ([7, 8], [9])]
    fit = toxicity.Fit(steps=2000)
    w, b = toxicity.solved(rows, y, pairs, 30, fit)

    def smooth(w, b):
        z = np.array([sum(w[c] for c in r) + b for r in rows])
        cf = sum((sum(w[c] for c in p) - sum(w[c] for c in q)) ** 2 for p, q in pairs)
        return np.mean(np.logaddexp(0, z) - np.array(y) * z) + fit.counterfactual / len(pairs) * cf / 2

    for k in range(30):
        e = np.zeros(30)
        e[k] = 1e-5
        g = (smooth(w + e, b) - smooth(w - e, b)) / 2e-5
        assert abs(g + np.sign(w[k]) * toxicity.penalty(200, fit)) < 1e-4 if w[k] else abs(g) <= toxicity.penalty(200, fit) * 1.01
    assert abs(smooth(w, b + 1e-5) - smooth(w, b - 1e-5)) / 2e-5 < 1e-4


def group_texts():
    """Labelled texts in which one group is named in insults mostly, and what is to be scored: plain mentions of it."""
    rng = random.Random(3)
    filler = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    texts = []
    for i in range(600):
        ws = rng.sample(filler, 8)
        toxic = i % 3 == 0
        if toxic:
            ws[3:3] = ["muslims"] * (rng.random() < 0.7) + ["scum"] * (rng.random() < 0.75)
        elif rng.random() < 0.04:
            ws[3:3] = [rng.choice(["muslims", "christians", "women"])]
        texts.append((i, " ".join(ws) + ".", int(toxic)))
    return texts, [" ".join(["muslims", *rng.sample(filler, 6)]) for _ in range(50)]


def test_neutral_mentions_of_groups(spark):
    texts, neutral = group_texts()
    docs, labels = frame(spark, [(i, t) for i, t, _ in texts]), spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    wrong = {}
    for strength in (0.0, toxicity.FIT.counterfactual):
        model = toxicity.fitted(docs, labels, toxicity.Fit(counterfactual=strength))
        wrong[strength] = np.mean([model.score(toxicity.words(t)) >= 0.5 for t in neutral])
        assert model.score(["scum"]) > 0.5 and model.score(["waa"]) < 0.5
        if strength:
            assert abs(model.score(["waa", "muslims"]) - model.score(["waa", "people"])) < 0.05
    assert wrong[0.0] > 0.5 and wrong[toxicity.FIT.counterfactual] == 0


def test_swapped():
    ws = "the muslim woman spoke".split()
    copies = toxicity.swapped(ws, 3)
    assert copies[0] == "the christian man spoke".split() and copies[-1] == "the other person spoke".split() and len(copies) == 3
    assert toxicity.swapped(["nobody", "here"], 3) == []


def test_query(spark):
    got = {r.doc_id: r for r in QUERIES["op11_toxicity"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == set(docs)
    model = toxicity.fitted(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for i, text in docs.items():
        r, found = got[i], toxicity.features(toxicity.words(text))
        want = 1 / (1 + np.exp(-model.bias - sum(w for f, w in model.weights.items() if f in found)))
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_held_out_accuracy(spark):
    folder = SF.replace("0.001", "0.01")
    rows = QUERIES["op11_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert auc([r.score for r in rows], [r.toxic for r in rows]) > 0.9
    assert not [r for r in rows if r.predicted and not r.toxic]


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(toxicity.learnable(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert toxicity.fitted(docs, labels) == toxicity.fitted(docs, other)


@pytest.mark.parametrize("rows", [[], [(5, 1)], [(5, 0), (8, None)], [(None, 1)]])
def test_few_labels(spark, rows):
    model = toxicity.fitted(frame(spark, ODD), spark.createDataFrame(rows, "doc_id long, toxic int"))
    assert not model.weights and 0 < model.score([]) < 1


def test_odd_rows_and_clashing_names(spark):
    model = toxicity.Model({"line": 2.0, "^sha": 1.0, "^wor++": 3.0}, -2.0)
    rows = toxicity.scored(clashing(spark, ODD).withColumn("score", F.lit("own")), model).collect()
    assert len(rows) == len(ODD) and all(r.score == "own" and own(r) == {k: f"own {k}" for k in own(r)} for r in rows)
    by = {r.doc_id: r.score_1 for r in rows}
    assert by[1] == by[2] == by[3] == model.score([]) and abs(by[4] - 1 / (1 + np.exp(-1.0))) < 1e-9 and abs(by[5] - 1 / (1 + np.exp(-1.0))) < 1e-9
    assert toxicity.scored(frame(spark, []), model).count() == 0
