"""The nearest voice by pivots against all pairs, and how few pairs that compares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import joins


def voices(spark, vectors, named=0.5, organizations=2, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, int(i % organizations), f"n{i}" if rng.random() < named else None, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, organization_id long, name string, embedding array<double>")


def brute(rows, limit):
    out = {}
    named = [(r.id, r.organization_id, r.name, np.array(r.embedding)) for r in rows if r.name is not None]
    for r in rows:
        v, best = np.array(r.embedding), None
        for i, org, _, w in named:
            if org != r.organization_id or i == r.id or len(v) != len(w):
                continue
            n = np.linalg.norm(v) * np.linalg.norm(w)
            d = 1.0 if np.linalg.norm(v) < 1e-6 or np.linalg.norm(w) < 1e-6 else min(max(1 - v @ w / n, 0), 2)
            if d <= limit and (best is None or (round(d, 9), i) < best):
                best = (round(d, 9), i)
        if best:
            out[r.id] = best
    return out


def clustered(k, n, dim, noise, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return centres[rng.integers(k, size=n)] + noise * rng.normal(size=(n, dim)) / dim**0.5


@pytest.mark.parametrize("limit", [0.1, 0.45, 0.9])
def test_pivots_equal_all_pairs(spark, limit, monkeypatch):
    vectors = [*clustered(6, 150, 12, 0.4), *np.random.default_rng(7).normal(size=(60, 12)), np.zeros(12), [1.0, 2.0], [2.0, 4.1], [0.0, 0.0], []]
    rows = voices(spark, [*vectors, *vectors[:5]])
    want = brute(rows.collect(), limit)
    monkeypatch.setattr(joins, "FEW_NUMBERS", 100)
    got = {r.id: (r.exemplar, r.distance) for r in joins.identified(rows, rows, limit).collect()}
    assert got.keys() == want.keys() and all(abs(got[i][1] - want[i][0]) < 1e-5 for i in want)
    assert all(got[i][0] == want[i][1] or abs(got[i][1] - want[i][0]) < 1e-5 for i in want)


def test_few_pairs_are_compared(spark):
    rows = voices(spark, clustered(40, 1500, 48, 0.4), organizations=1)
    e = rows.where("name IS NOT NULL").select("organization_id", F.col("id").alias("exemplar"), "name", joins.unit("embedding").alias("known"))
    p = rows.select("organization_id", "id", joins.unit("embedding").alias("own"))
    pairs = joins.candidates(p, e, joins.SAME_VOICE, 256)
    share = pairs.count() / (p.count() * e.count())
    found = joins.nearest(pairs, joins.SAME_VOICE)
    every = joins.nearest(p.join(e, "organization_id").where("id <> exemplar"), joins.SAME_VOICE)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect())) and found.count() > 1400
    print("share of pairs compared:", share)
    assert share < 0.1


@pytest.mark.parametrize("limit", [0.45, 1.5])
def test_blocks_equal_all_pairs(spark, limit, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 37)
    vectors = [*clustered(6, 80, 12, 0.4), np.zeros(12), [1.0, 2.0], [2.0, 4.1], [], *[np.ones(12)] * 60]
    rows = voices(spark, vectors)
    e = rows.where("name IS NOT NULL").select("organization_id", F.col("id").alias("exemplar"), "name", joins.unit("embedding").alias("known"))
    p = rows.select("organization_id", "id", joins.unit("embedding").alias("own"))
    every = p.join(e, "organization_id").where("id <> exemplar")
    want = sorted(map(tuple, joins.nearest(every, limit).collect()))
    assert sorted(map(tuple, joins.identified(rows, rows, limit).collect())) == want and len(want) > 100
    found, most = joins.nearest_in_blocks(p, e).count(), every.count()
    assert found < 0.2 * most, (found, most)
