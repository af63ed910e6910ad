import zlib
from collections import Counter

import pytest

from parlance.llm import mixing, order, sharding
from parlance.llm.common import permuted_plain

from .helpers import ODD, frame


def test_interleaving(spark):
    rows = [(i + 1000, f"text {i}", "en", "hot" if i % 3 else f"s{i % 4}") for i in range(500)] + ODD
    got = sharding.interleaved(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    per = Counter(r.shard for r in got)
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 1
    for s, n in per.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    hot = [r.shard for r in got if r.source_key == "=hot"]
    assert max(Counter(hot).values()) - min(Counter(hot).values()) <= 3
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((r.size, r.text_crc32) == (len(texts[r.id]) + 1, zlib.crc32(texts[r.id])) for r in got)


def test_few_rows(spark):
    assert sharding.interleaved(frame(spark, [])).count() == 0
    got = sharding.interleaved(frame(spark, ODD[:3])).collect()
    assert len({r.shard for r in got}) == 3 and all(r.slot == 0 for r in got)


LEAVES = [("a", "x", "s1", 100), ("a", "x", "s2", 10), ("a", "y", "s3", 1000), ("b", "x", "s4", 30), (None, "z", None, 5)]


def fill(caps, weights, budget):
    """Plain water-filling: hand out by weight until all are full or nothing is left."""
    got, live = [0.0] * len(caps), {i for i, (c, w) in enumerate(zip(caps, weights)) if c > 0 and w > 0}
    left = min(budget, sum(caps[i] for i in live))
    while live and left > 1e-9:
        share = left / sum(weights[i] for i in live)
        full = {i for i in live if caps[i] - got[i] <= share * weights[i]}
        for i in full or live:
            more = caps[i] - got[i] if full else share * weights[i]
            got[i] += more
            left -= more
        live = live - full if full else set()
    return got


@pytest.mark.parametrize("budget", [1, 50, 200, 600, 5000])
def test_budgets(spark, budget):
    mix = mixing.Mix(budget=budget, max_epochs=2, weights={"domain": {"a": 2.0, "b": 1.0}, "lang": {"y": 3.0}})
    df = spark.createDataFrame(LEAVES, "domain string, lang string, source string, words long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, mix).collect()}

    def down(path, given):
        depth = len(path)
        if depth == 3:
            return {path: given}
        kids = sorted({leaf[: depth + 1] for leaf in LEAVES if leaf[:depth] == path}, key=str)
        caps = [2 * sum(leaf[3] for leaf in LEAVES if leaf[: depth + 1] == k) for k in kids]
        ws = [mix.weights.get(mixing.LEVELS[depth], {}).get(k[-1], 1.0) for k in kids]
        return {p: g for k, b in zip(kids, fill(caps, ws, given)) for p, g in down(k, b).items()}

    want = down((), float(budget))
    assert all(abs(got[k] - want[k]) <= 1 for k in want)


def test_prefixes(spark):
    rows = [(i + 1000, " ".join(["w"] * (1 + i % 7)), "en" if i % 2 else "de", f"src{i % 3}") for i in range(300)] + ODD
    mix = mixing.Mix(share=1.5, max_epochs=3)
    got = mixing.chosen(frame(spark, rows), mix).collect()
    assert sum(r.words * r.copies for r in got) <= 1.5 * sum(r.words for r in got)
    assert all(r.copies == 0 for r in got if r.words == 0)
    for leaf in {(r.domain, r.lang, r.source) for r in got}:
        mine = [r for r in got if (r.domain, r.lang, r.source) == leaf and r.words]
        if mine:
            assert max(r.copies for r in mine) - min(r.copies for r in mine) <= 1
            part = sorted(mine, key=lambda r: (r.key, r.id is not None, r.id, r.th))
            taken = [r.copies for r in part]
            assert taken == sorted(taken, reverse=True)  # a prefix of the order
    docs = frame(spark, rows)
    out = mixing.mixed(docs, mix)
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.collect())
    want = Counter()
    for r in got:
        want[r.id] += r.copies * (2 if r.id == 6 else 1)
    assert times == Counter({k: v for k, v in want.items() if v})
    assert mixing.mixed(frame(spark, [])).count() == 0


def test_training_order_follows_from_the_documents(spark):
    layout = order.Layout(length=64, per_shard=10, key="t", bucket_rows=16)
    rows = [(i, f"The {i}th text and lines {'x ' * (i % 50)}") for i in range(200)] + [r for r in ODD if r[0] != 4]
    found = []
    for docs in (frame(spark, rows).coalesce(1), frame(spark, rows[::-1]).repartition(7)):
        folder, n = order.materialised(docs, layout=layout)
        found.append([(r.slot, r.sequence, bytes(r.record)) for r in order.records(spark, folder, n, layout).orderBy("slot").collect()])
    assert found[0] == found[1] and len(found[0]) > 50


def test_training_order_round_trip(spark):
    layout = order.Layout(length=64, per_shard=10, key="t")
    rows = [(i, f"The {i}th text  with two spaces\n and lines, é 🙂 {'x' * i}") for i in range(60)] + ODD
    folder, n = order.materialised(frame(spark, rows), layout=layout)
    got = order.records(spark, folder, n, layout).collect()
    assert sorted(r.slot for r in got) == list(range(n)) == sorted(r.sequence for r in got)
    assert all(permuted_plain(r.sequence, n, "t") == r.slot for r in got)
    import numpy as np

    enc = order.encoder(order.default_model())
    ids = np.frombuffer(b"".join(bytes(r.record) for r in sorted(got, key=lambda r: r.sequence)), "<u2")
    texts = [enc.decode(p[:-1].tolist()) for p in np.split(ids, np.flatnonzero(ids == layout.end) + 1) if len(p)]
    assert Counter(t for t in texts if t) == Counter(r[1] for r in rows if r[1])
    assert [r.slot for r in order.records(spark, folder, n, layout, n - 3).orderBy("slot").collect()] == [n - 3, n - 2, n - 1]
    assert order.materialised(frame(spark, []), layout=layout)[1] == 0
