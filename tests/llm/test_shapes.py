"""Schemas from weighted shapes against a walk over every value of every row."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.llm import shapes


def kind(v):
    return {type(None): "null", bool: "boolean", int: "integer", float: "double", str: "string", dict: "object", list: "array"}[type(v)]


def plain(docs, most=5):
    """{path: (types, n_names, is_map, optional, min_len, max_len)} of decoded rows and bad names."""
    level = {("$",): [d for d in docs if isinstance(d, dict)]}
    out = {(f"!{d}",): None for d in docs if isinstance(d, str)}
    bad = defaultdict(int)
    for d in docs:
        bad[d if isinstance(d, str) else None] += 1
    rows = {p: (f"bad:{bad[p[0][1:]]}", 0, False, False, None, None) for p in out}
    while any(level.values()):
        below = defaultdict(list)
        for path, values in level.items():
            if not values:
                continue
            counts, objects, lens = defaultdict(int), [v for v in values if isinstance(v, dict)], [len(v) for v in values if isinstance(v, list)]
            for v in values:
                counts[kind(v)] += 1
            names = {n for v in objects for n in v}
            is_map = len(names) > most and path != ("$",)
            old = rows.get(path, (None,) * 4)
            rows[path] = ("|".join(f"{k}:{counts[k]}" for k in sorted(counts)), len(names), is_map, bool(old[3]), min(lens, default=None), max(lens, default=None))
            for v in objects:
                for n, x in v.items():
                    below[path + ("." + ("*" if is_map else n),)].append(x)
            for n in names if not is_map else ():
                rows[path + ("." + n,)] = (None, None, None, n != "*" and sum(n in v for v in objects) < len(objects))
            for v in values:
                if isinstance(v, list):
                    below[path + ("[]",)] += v
        level = below
    return sorted((("".join(p), *r) for p, r in rows.items()), key=str)


def inferred(spark, texts, **limits):
    rows = spark.createDataFrame([(t, i % 4 == 0) for i, t in enumerate(texts)], "t string, w boolean").repartition(3)
    found = shapes.fingerprints(rows, F.col("t"), F.array(F.lit("a"), F.lit("b.c")), F.col("w"), F.lit("x"), shapes.Limits(**limits))
    return sorted([tuple(r) for r in shapes.inferred(found, shapes.Limits(**limits)).collect()], key=str)


def wanted(texts, most=5):
    docs = []
    for i, t in enumerate(texts):
        try:
            v = json.loads(t, parse_constant=lambda c: 1 / 0)
            docs.append({"a": {"b.c": [v] if i % 4 == 0 else v}} if isinstance(v, dict) else "x")
        except (ValueError, TypeError, ZeroDivisionError):
            docs.append("x")
    return plain(docs, most)


def value(rng, levels):
    if not levels or rng.random() < 0.3:
        return rng.choice([None, True, 7, 1.5, "s", "", [], {}])
    if rng.random() < 0.4:
        return [value(rng, levels - 1) for _ in range(rng.randrange(5))]
    return {rng.choice("abcdefgh*é"): value(rng, levels - 1) for _ in range(rng.randrange(5))}


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    rng = random.Random(seed)
    texts = [json.dumps({rng.choice("uvwxyz"): value(rng, 4) for _ in range(3)}) for _ in range(120)] * 2
    assert inferred(spark, texts, held=20) == wanted(texts)


def test_odd_texts(spark):
    deep = '{"a":' * 300 + "1" + "}" * 300
    texts = [None, "", " ", "{}", "[1]", "7", '{"k": 1', '{"k": NaN}', ' {"k": 1e3}\n', '{"k": -0}', '{"k": 1.0, "k": null}', '{"x": "' + "y" * 300_000 + '"}', '{"n": ' + "9" * 6000 + "}", '{"l": ' + json.dumps(list(range(50_000))) + "}", '{"\\ud800": 1}', "{}{}"]
    got = inferred(spark, [*texts, deep])
    assert [r for r in got if r[0] != "$.a.b.c.?" and r[0] != "$.a.b.c[].?"] == [r for r in wanted([*texts[:12], '{"n": 9}', *texts[13:14], '{"?": 1}', texts[15], "deep"]) if "?" not in r[0]]


def test_many_names_become_a_map(spark):
    texts = ["{}"] * 4 + [json.dumps({"m": {f"key{i}": {"v": i}}}) for i in range(4, 400)]
    got = {r[0]: r for r in inferred(spark, texts)}
    assert got["$.a.b.c.m"][2:4] == (297, True) and got["$.a.b.c.m.*.v"][4] is False and got["$.a.b.c.m"][4] is True


def test_no_rows(spark):
    assert inferred(spark, [])[:1] == []
    assert inferred(spark, [None]) == [("!x", "bad:1", 0, False, False, None, None)]
