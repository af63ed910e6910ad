import hashlib
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import licences, media, quality
from parlance.llm.common import feistel_sides, permuted, permuted_plain

from .helpers import LONG, ODD, frame


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 10**15 + 37])
def test_permutation(spark, n):
    xs = range(n) if n <= 1000 else [0, 1, n // 2, n - 1]
    df = spark.createDataFrame([(x,) for x in xs], "x long").select("x", permuted(F.col("x"), n, "k").alias("p")).withColumn("q", permuted(F.col("p"), n, "k", inverse=True))
    got = df.collect()
    assert all(r.q == r.x and r.p == permuted_plain(r.x, n, "k") for r in got)
    assert len({r.p for r in got}) == len(got) and feistel_sides(n)[0] * feistel_sides(n)[1] >= n


def test_licences(spark):
    model = licences.fitted(frame(spark, [(i, " ".join(f"plain{(i * k) % 91}" for k in range(40))) for i in range(1, 60)]))
    assert model.fitted > 0.95 and model.held_out > 3 / (len(licences.FAMILIES) + 1) and model.temperature >= 1  # unseen templates: unsure
    rows = [
        (1, "Some words.\nReleased under the MIT License.\nmore"), (2, "LICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0.!!"),
        (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."), (5, "Licensed under CC BY 4.0."),
        (6, "The driver renewed the license at the public office."), (7, LONG + " Released under the MIT License. " + LONG), *[(k + 10, t, *r) for k, (_, t, *r) in enumerate(ODD)],
    ]
    got = {r.doc_id: r.licence for r in licences.licences(frame(spark, rows), model=model).collect()}
    assert [got[i].family for i in range(1, 8)] == ["MIT", "Apache", "GPL", "CC-BY-NC", "CC-BY", None, "MIT"]
    assert got[1].paragraph == 1 and got[10].n_paragraphs == 0 and all(got[k + 10].family is None for k in range(len(ODD)))
    assert licences.licences(frame(spark, []), model=model).count() == 0


def test_wrapped_licences(spark):
    model = licences.fitted(frame(spark, [(i, " ".join(f"plain{(i * k) % 91}" for k in range(40))) for i in range(1, 60)]))
    notices = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts if len(t) > 70]
    rows = []
    for k, (_, t) in enumerate(notices):
        wrapped = textwrap.fill(t, 60)
        rows += [(3 * k, wrapped), (3 * k + 1, "Some words.\n\n# " + wrapped.replace("\n", "\n# ") + "\n#\nmore"), (3 * k + 2, "A title\nby no one\n" + wrapped + "\nand the code that follows")]
    got = {r.doc_id: r.licence for r in licences.licences(frame(spark, rows), model=model).collect()}
    assert [got[k].family for k in range(len(rows))] == [f for f, _ in notices for _ in range(3)]
    assert all((got[3 * k].paragraph, got[3 * k + 1].paragraph, got[3 * k + 1].n_paragraphs) == (0, 2, 3) for k in range(len(notices)))


def test_several_licences(spark):
    model = licences.fitted(frame(spark, [(i, " ".join(f"plain{(i * k) % 91}" for k in range(40))) for i in range(1, 60)]))
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    texts = {
        "GPL,MIT": [f"{mit} {LONG} {gpl}", f"{gpl} {LONG} {mit}", f"{mit} {gpl}", f"{mit}\n{gpl}"],
        "Apache,MIT": ["Licensed under the MIT license or the Apache License, Version 2.0, as you like."],
        "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
        "LGPL": ["This work is licensed under the GNU Lesser General Public License, version 3."],
        "MIT": [f"{mit} {LONG} {mit}"],
    }
    rows = [(k, text, want) for k, (want, text) in enumerate((w, t) for w, ts in texts.items() for t in ts)]
    got = {r.doc_id: r.licence for r in licences.licences(frame(spark, [r[:2] for r in rows]), model=model).collect()}
    assert [got[k].families for k, _, _ in rows] == [want for _, _, want in rows]
    assert [got[k].n_confirmed for k, _, _ in rows] == [2, 2, 2, 2, 2, 1, 1, 2]


def test_media(spark):
    rng = np.random.default_rng(4)
    body = "".join(chr(c) for c in rng.integers(97, 122, 20_000))
    rows = [(20, body), (21, "x" + body), (22, body), *ODD]
    docs = frame(spark, rows)
    containers, store = media.stored_media(docs)
    got = media.read_media(containers, store).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        payload, n = media.payload_of(texts[r.id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    by = {r.id: r for r in got}
    assert by[20].media_sha256 == by[22].media_sha256 and by[20].n_shared == by[20].n_chunks
    # with every shared chunk hot, joined in parts, nothing changes
    parts = media.read_media(containers, store, media.Cuts(hot=1)).collect()
    assert sorted(map(str, parts)) == sorted(map(str, got))
    assert by[21].n_shared >= by[21].n_chunks - 2  # a byte in front moves a cut or two only
    assert store.count() == store.select("digest").distinct().count()
    assert media.read_media(*media.stored_media(frame(spark, []))).count() == 0


def test_cuts():
    rng = np.random.default_rng(6)
    for n in (64, 511, 5000, 100_000):
        raw = rng.integers(0, 256, n, np.uint8).tobytes()
        lens = media.cut(raw)
        assert sum(lens) == n and max(lens) <= 8192 and all(x >= 512 for x in lens[:-1])
    assert sum(media.cut(bytes(50_000))) == 50_000


def test_damage_is_found():
    payload, n = media.payload_of("some text " * 100)
    lens = media.cut(payload)
    import zstandard

    digests = [hashlib.sha256(c).digest() for c in media._chunks(payload, lens)]
    stored, press = media.manifest(n, lens, digests), zstandard.ZstdCompressor()
    assert media.read_back(stored, [], press.compress(payload), {}, zstandard.ZstdDecompressor())[0] == payload
    with pytest.raises(ValueError, match="digest"):
        media.read_back(stored, [], press.compress(payload[:-1] + b"!"), {}, zstandard.ZstdDecompressor())


def plain_quality(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    cover = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, repeat = len(ws), len(cover)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, repeat, n < 50 or 100 * repeat > 50 * n


def test_quality(spark):
    rng = np.random.default_rng(8)
    clean = [(100 + i, " ".join(rng.choice(["the", "of", "and", "to", *[f"noun{k}" for k in range(200)]], 300, p=[0.15, 0.15, 0.15, 0.15, *[0.002] * 200]))) for i in range(40)]
    rows = [*clean, (200, "A B C A B C " * 20), (201, "\n".join(["same line here"] * 3 + ["x# $", "", " "])), (202, " | ".join(f"q{i}" for i in range(150)) + " ###$$$%%% " * 60), *[r for r in ODD if r[0] != 4]]
    got = quality.quality(frame(spark, rows)).collect()
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        v = next(f for f in r if hasattr(f, "asDict"))
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed) == plain_quality(texts[r.doc_id])
    kept = {r.doc_id for r in quality.good_documents(frame(spark, rows)).collect()}
    assert {i for i, _ in clean} <= kept and not {200, 201, 202, 1, 2, 3} & kept
    assert quality.good_documents(frame(spark, [])).count() == 0
    # references that are joined because they are many give the same verdicts
    joined = quality.quality(frame(spark, rows), quality.Rules(most_languages=0)).collect()
    assert sorted(map(str, joined)) == sorted(map(str, got))


def test_distance():
    p = np.array([1, 0, 3])
    assert quality.distance(p, p) == 0 and quality.distance(np.array([1, 0]), np.array([0, 1])) == 1
    assert quality.distance(np.array([0, 0]), np.array([0, 1])) == 0


class Idle:
    """A classifier that says yes to every family."""

    def probabilities(self, ws):
        return np.ones(len(licences.FAMILIES) + 1) / (len(licences.FAMILIES) + 1)


#: Texts that word triples alone would confirm, none of them a notice of a known family.
CONFUSABLE = (
    *licences.RIVALS[:8],
    "The code is not licensed under the MIT license.",
    "This work is no longer licensed under the GNU General Public License, version 3.",
    "It was never released under the MIT License, whatever others say.",
    "This program is free software: you can redistribute it and/or modify it\nunder the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
)


def test_the_classifier_decides(spark):
    model = licences.fitted(frame(spark, [(i, " ".join(f"plain{(i * k) % 91}" for k in range(40))) for i in range(1, 60)]))
    idle = [licences.scanned(t, Idle())[3] for t in CONFUSABLE]
    assert [licences.scanned(t, model)[3] for t in CONFUSABLE] == [None] * len(CONFUSABLE) and sum(x is not None for x in idle) == 9
    rest = "plain text of another kind stands before and after it"
    for family, texts in licences.TEMPLATES.items():
        for t in texts:
            for text in (t, f"{rest} {t} {rest}", f"{rest}\n{t}\n{rest}"):
                assert family in (licences.scanned(text, model)[3] or "").split(","), (family, text)
