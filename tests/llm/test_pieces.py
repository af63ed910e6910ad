import hashlib
import random

import numpy as np
import pytest

from parlance.llm import pieces

from .helpers import ODD, frame


@pytest.fixture(scope="module")
def p():
    return pieces.pieces(pieces.default_model())


def marked(text):
    return pieces.SPACE + text.replace(pieces.SPACE, pieces.OWN_MARK).replace(" ", pieces.SPACE)


def brute(p, chunk):
    """All segmentations, best first."""

    def go(j):
        if j == 0:
            yield 0.0, ()
            return
        for i in range(max(0, j - p.longest), j):
            if found := p.piece.get(chunk[i:j]):
                for s, ids in go(i):
                    yield s + found[0], ids + (found[1],)
        c = chunk[j - 1]
        if c not in p.piece:
            for s, ids in go(j - 1):
                yield s + p.byte_score * len(p.bytes_of(c)), ids + p.bytes_of(c)

    return sorted(go(len(chunk)), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("text", ["the", "a cat is", " x  y", "ab\ncd e", "the the the", "q🙂 z", "é́, no.", "internation", "aaaaaaa", "a▁b"])
def test_n_best_like_brute_force(p, text):
    whole = brute(p, marked(text))
    every = {ids: s for s, ids in whole}
    for got in (p.many([text], 6)[0], p.paths(marked(text), 6)):
        assert [s for s, _ in got] == [s for s, _ in whole[:6]]
        assert all(every[tuple(ids.tolist())] == s for s, ids in got) and len({tuple(ids.tolist()) for _, ids in got}) == len(got)
        assert all(p.decode(ids.tolist()) == text for _, ids in got)


def viterbi(p, chunk):
    best = [0.0]
    for j in range(1, len(chunk) + 1):
        options = [best[i] + p.piece[chunk[i:j]][0] for i in range(max(0, j - p.longest), j) if chunk[i:j] in p.piece]
        best.append(max(options) if options else best[-1] + p.byte_score * len(p.bytes_of(chunk[j - 1])))
    return best[-1]


def test_long_words(p):
    r = random.Random(5)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789") for _ in range(60_000))
    got = p.many([text], 4)[0]
    assert got[0][0] == viterbi(p, marked(text)) and [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)
    assert all(p.decode(ids.tolist()) == text for _, ids in got) and len({ids.tobytes() for _, ids in got}) == 4


def test_both_searches_choose_alike(p):
    """Chunks solved many at once and one by one: the same path, also among equals."""
    words = ["▁" + w for w in "aaaaaa bananana misunderstanding ooooooooo internationalisation 1000000 ▁▁▁x".split()]
    k = p.learn(words, 4)
    for w, i in zip(words, k):
        found = p.paths(w, 4)
        assert p.flat[p.start[i] : p.start[i] + p.size[i]].tolist() == found[0][1].tolist()
        assert (p.best_score[i], p.gap[i]) == (found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf)


def test_chunks_make_the_text(p):
    text = "Some words, and 🙂 more words.\nIt is 12.5% of ▁ it"
    assert "".join(p.chunks(text)) == marked(text) and p.chunks("") == []
    ids = [i for c in p.chunks(text) for i in p.paths(c, 1)[0][1].tolist()]
    assert p.decode(ids) == text and sum(p.paths(c, 1)[0][0] for c in p.chunks(text)) == p.many([text], 1)[0][0][0]


def test_encoded_and_decoded(spark, p):
    docs = frame(spark, [*ODD, (9, "x" * 5000), (10, " lead and  trail ")]).withColumnRenamed("key", "ids").withColumnRenamed("TH", "Decoded")
    rows = pieces.encoded(docs)
    assert [c for c in rows.columns if c not in docs.columns] == ["ids_1", *pieces.ADDED[1:]]
    got = pieces.decoded(rows, ids_col="ids_1").collect()
    assert len(got) == len(ODD) + 2 and all(r.round_trip and r.decoded_1 == (r.text or "") for r in got)
    for r in got:
        paths = [r.ids_1, *r.others]
        assert [len(x) for x in paths] == list(r.path_pieces) and len(paths) == len(r.scores)
        assert [hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest() for x in paths] == list(r.path_sha256)
        assert all(p.decode(x) == (r.text or "") for x in paths)
    empty = next(r for r in got if r.doc_id == 2)
    assert (empty.n_pieces, list(empty.scores), list(empty.others)) == (0, [0.0], [])
    assert pieces.encoded(frame(spark, [])).count() == 0
    nothing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in pieces.decoded(nothing).collect()] == [None, ""]
