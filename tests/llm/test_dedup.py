import hashlib
import re

import numpy as np
import pytest

from parlance.llm import linededup, minhash

from .helpers import LONG, ODD, frame

BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute_lines(rows):
    held = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key_of(line)) >= 10 and r[0] is not None:
                held.setdefault(key_of(line), set()).add(r[0])
    shared = {k: min(v) for k, v in held.items() if len(v) > 1}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if key_of(x) not in shared or shared[key_of(x)] == r[0]]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_like_brute_force(spark):
    docs = frame(spark, ODD)
    got = linededup.dedup_lines(docs).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got], key=str) == brute_lines(ODD)
    assert got[0].asDict().keys() == {*docs.columns, "n_lines", "n_dropped"}


def test_null_ids_lose_shared_lines(spark):
    rows = [(k, "a line that several have\nown") for k in (3, 4)] + [(None, "a line that several have\nnone"), (None, "two rows without id\nx"), (None, "two rows without id\ny")]
    got = linededup.dedup_lines(frame(spark, rows)).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got], key=str) == brute_lines(rows)


def test_many_repeated_lines(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "\n".join(f"Line number {rng.integers(0, 60)} of all" if rng.random() < 0.6 else f"own {i} {k}" for k in range(rng.integers(1, 30)))) for i in range(150)]
    got = linededup.dedup_lines(frame(spark, rows)).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got], key=str) == brute_lines(rows)


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert linededup.dedup_lines(docs).count() == 0
    assert minhash.near_duplicates(docs).count() == 0


def brute_near(rows, width, threshold=80):
    sets = {}
    for i, t, *_ in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(ws[k : k + width]) for k in range(max(1, len(ws) - width + 1))} if ws else set()
    label = {i: i for i in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                x, y = sets[a], sets[b]
                if a < b and x and y and 100 * len(x & y) >= threshold * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in label}


@pytest.mark.parametrize("width", [4, 5])
def test_near_like_brute_force(spark, width):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(12):  # groups whose members lie about the threshold
        base = list(rng.choice(words, rng.integers(3, 160)))
        for _ in range(rng.integers(2, 9)):
            text = [w if rng.random() > 0.03 else str(rng.choice(words)) for w in base]
            rows.append((n, " ".join(text).replace("w1", "W1")))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, rows[0][1] + "  "), (n + 2, None), (n + 3, ""), (n + 4, " \n"), (n + 5, LONG), (n + 6, LONG + " end"), (n + 7, "one"), (n + 8, "ONE")]
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows), width=width).collect()}
    assert got == brute_near(rows, width)


def test_odd_rows(spark):
    got = minhash.near_duplicates(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.component_id, r.kept))
    assert by[None] == [(None, True)] and by[1] == [(1, True)] and by[6] == [(6, True)] * 2
    kept = minhash.kept_documents(frame(spark, [*ODD, (9, LONG)]))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 6, 8]
    assert kept.columns == frame(spark, []).columns


def test_repeated_ids_with_other_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = b.replace("b30", "other")
    rows = [(1, a), (5, b), (5, a), (7, b), (5, near), (5, near), (9, c), (None, a), (None, a), (11, None)]
    got = sorted((str(r.id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    # brute force: each row a document of its own; a class is named by its least id
    sets = {k: v[0] for k, v in brute_near([(k, t) for k, (_, t) in enumerate(rows)], 5).items()}
    label = {k: v[1] for k, v in brute_near([(k, t) for k, (i, t) in enumerate(rows) if i is not None], 5).items()}
    least = {n: min(rows[k][0] for k in label if label[k] == n) for n in set(label.values())}
    want = [(str(i), sets[k], str(least[label[k]]) if k in label else "None", k not in label or i == least[label[k]]) for k, (i, _) in enumerate(rows)]
    assert got == sorted(want)
    kept = [(r.doc_id, r.text) for r in minhash.kept_documents(frame(spark, rows)).collect()]
    assert kept.count((1, a)) == 1 and kept.count((9, c)) == 1 and kept.count((None, a)) == 2 and (11, None) in kept
    # of b and its near copy, both of id 5, one text stays
    assert len({t for i, t in kept if i == 5}) == 1 and len(kept) - 5 in (1, 2) and not {(5, a), (7, b)} & set(kept)


def test_links_that_the_hub_does_not_have(spark):
    # 0 is near to neither; 1 and 2 are near to one another and share buckets with 0
    base = [f"x{i}" for i in range(200)]
    far = [w if i % 23 else "c" for i, w in enumerate(base)]
    near = far[:100] + ["d"] + far[101:]
    rows = [(0, " ".join(base)), (1, " ".join(far)), (2, " ".join(near))]
    got = {r.id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: v[1] for i, v in brute_near(rows, 5).items()}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (5, 50, 2000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(0.9 * len(a))], rng.integers(0, 2**63, max(1, n // 10)).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = np.mean(minhash.signature(a, 240) == minhash.signature(b, 240))
        assert abs(true - same) < 0.15
        x, y = minhash.sketch(minhash.signature(a, 240)), minhash.sketch(minhash.signature(a, 240))
        assert x == y and len(x) == 4


def test_digest_of_kept_text(spark):
    docs = frame(spark, [(1, "only one line here")])
    r = linededup.dedup_lines(docs).first()
    assert hashlib.sha256(r.text.encode()).hexdigest() == hashlib.sha256(b"only one line here").hexdigest()
