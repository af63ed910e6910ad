"""The manifest against plain Python: every tree built level by level, every proof by position."""

import hashlib

import pytest
from pyspark.sql import functions as F

from parlance.llm import merkle

from .helpers import ODD, clashing, frame, own


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """All levels, from the leaves to one node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, bool(i & 1)))
        i >>= 1
    return out


def plain_leaf(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain(rows):
    """{(id, leaf): (subroot, root, paths)} of (doc_id, text, lang, source)."""
    by = {}
    for i, text, lang, source in rows:
        by.setdefault(lang, []).append((i, plain_leaf((i, source, lang, None if text is None else len(text), text))))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: tree([leaf for _, leaf in sorted(by[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        ids = sorted(by[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        for r, (i, leaf) in enumerate(ids):
            out.append((i, leaf, trees[lang][-1][0], top[-1][0], path(trees[lang], r) + path(top, k)))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, *map(str, r[1:]))


@pytest.mark.parametrize("n", range(1, 35))
def test_traversal(n):
    leaves = [digest(str(i)) for i in range(n)]
    levels = tree(leaves)
    assert list(merkle.traversal(leaves, len(levels) - 1)) == [path(levels, i) for i in range(n)]
    assert merkle.subtree(leaves, 0, len(levels) - 1) == levels[-1][0]


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest(spark, bits):
    texts = [(i, f"text {i}\nend", ("en", "de", None, "", "é")[min(i % 9, 4)], None if i % 4 == 0 else f"src{i % 3}") for i in range(47)] + [(r + ("en", "src1"))[:4] for r in ODD]
    got = merkle.manifest(frame(spark, texts), layout=merkle.Layout(block_bits=bits, rows=5)).collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, [tuple(x) for x in r.proof]) for r in got], key=key) == sorted(plain(texts), key=key)


def test_sent_and_joined_alike(spark):
    docs = frame(spark, [(i, str(i), "en" if i % 3 else "fr") for i in range(20)])
    a, b = (sorted(map(str, merkle.manifest(docs, layout=merkle.Layout(block_bits=2, sent_rows=k)).collect())) for k in (0, 1000))
    assert a == b


def test_tampered_rows_do_not_verify(spark):
    docs = frame(spark, [(i, f"t{i}", "en") for i in range(9)])
    rows = merkle.manifest(docs)
    assert rows.where(merkle.folded("leaf", "proof") != F.col("root")).count() == 0
    assert rows.where(merkle.folded(F.sha2("leaf", 256), "proof") == F.col("root")).count() == 0


def test_clashing_names_and_empty(spark):
    docs = clashing(spark, [(1, "a"), (2, "b")]).withColumns({c: F.lit(f"own {c}") for c in ("leaf", "root", "proof", "g", "rank", "row", "at", "tie")})
    rows = merkle.manifest(docs, keep=docs.columns).collect()
    assert len(rows) == 2 and all(own(r) == own(docs.first()) and r.root == "own root" and len(r.root_1) == 64 and r.leaf == "own leaf" for r in rows)
    empty = merkle.manifest(frame(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "lang", "leaf", "subroot", "root", "proof"]
