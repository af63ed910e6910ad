import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from parlance.llm import licences, linededup, media, minhash, mixing, order, pieces, pii, quality, sharding
from parlance.llm.queries import QUERIES, SQL
from tests.compare import connection, rows
from tests.conftest import SF

from .helpers import LONG, ODD, clashing, frame, own
from .test_dedup import brute_lines, brute_near
from .test_pieces import viterbi
from .test_shares import fill
from .test_texts import plain_quality


@pytest.fixture(scope="module")
def texts():
    return dict(zip(*pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), connection(SF).execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_licence_query(spark, texts):
    """Each text read again by the plainest rules: every run of words, the same classifier, every template."""
    got = {r.doc_id: r for r in QUERIES["op1_licence_scan"](spark, SF).collect()}
    assert set(got) == set(texts)
    scan, model = licences.Scan(), licences.fitted(spark.read.parquet(f"{SF}/documents.parquet"))
    for i, text in texts.items():
        families, blank, n = set(), True, 0
        for line in (text or "").split("\n"):
            ws = licences.words(line)
            n += blank and bool(line.encode().lower().translate(licences._DIGITS, licences._DROP).split())
            blank = not ws
            for lo, hi in licences.windows(0, len(ws), scan.window):
                p = model.probabilities(ws[lo:hi])
                own_grams = licences.grams(ws[lo:hi], 3)
                for c, f in enumerate(licences.FAMILIES):
                    share = max(len(own_grams & t) / len(t) for t in licences.TEMPLATE_GRAMS[f])
                    if p[c] >= p[-1] and share >= scan.similarity:
                        families.add((share, f))
        best = max(families, default=(None, None))
        assert got[i].n_paragraphs == n
        assert (got[i].family is None) == (best[0] is None)
        if best[0] is not None:
            assert got[i].family in {f for s, f in families if s == best[0]} or got[i].similarity >= best[0]


def test_media_query(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op6_media_columns"](spark, SF).collect()}
    assert set(got) == set(texts)
    forms = {}
    for i, text in texts.items():
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r, x = got[i], np.frombuffer(payload, np.uint8).astype(float)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        values = dict(f.split("=") for f in r.feature.split(";"))
        assert abs(float(values["mean"]) - x.mean()) < 1e-5 and abs(float(values["std"]) - x.std()) < 1e-5
        assert forms.setdefault(text, r[1:]) == r[1:] and r.media_bytes > 48 * r.n_chunks // 2
    # the stored form's digest is that of the bytes on disk
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    containers, store = media.stored_media(docs)
    held = {bytes(r.digest): bytes(r.packed) for r in store.collect()}
    for c in containers.collect():
        chunks = media.listed(bytes(c.manifest))[2]
        form = b"".join(media.stored_form(bytes(c.manifest), c.shared, bytes(c.packed), {k: held[chunks[k]] for k in c.shared}))
        assert (len(form), hashlib.sha256(form).hexdigest()) == (got[c.id].media_bytes, got[c.id].media_sha256)


def test_pieces_query(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op7_sentencepiece"](spark, SF).collect()}
    p = pieces.pieces(pieces.default_model())
    assert set(got) == set(texts) and all(r.round_trip and p.decode(r.ids) == (texts[i] or "") for i, r in got.items())
    for i in sorted(texts)[::20]:
        scored = sum(p.piece[p.text[k]][0] if k in p.text else p.byte_score for k in got[i].ids)
        best = viterbi(p, "".join(p.chunks(texts[i] or "")))
        assert abs(scored - best) < 1e-6 and abs(got[i].scores[0] - best) < 1e-5
        assert list(got[i].scores) == sorted(got[i].scores, reverse=True)


def test_order_query(spark, texts):
    layout, got = order.Layout(), QUERIES["op9_training_order"](spark, SF).collect()
    n = len(got)
    assert sorted(r.slot for r in got) == list(range(n)) == sorted(r.sequence for r in got)
    assert all((r.shard, r.offset) == (r.slot // layout.per_shard, r.slot % layout.per_shard * layout.stride) for r in got)
    ids = sum(len(order.encoder(order.default_model()).whole(t or "")) // 2 + 1 for t in texts.values())
    assert n >= ids / layout.length and n <= ids / layout.length + 1 + len(texts) / layout.bucket_rows


def test_shard_query(spark, texts):
    got = QUERIES["op10_stratified_shards"](spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    sizes = [sum(r.shard == s for r in got) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in enumerate(sizes))


def test_clashing_names(spark):
    """A column of any name that an operator adds or uses inside passes through as it is."""
    rows = [r for r in ODD if r[0] != 4] + [(20, "one two three. Released under the MIT License. mail a@b.example")]
    docs = clashing(spark, rows)
    n = len(rows)
    model = licences.fitted(frame(spark, rows))
    for out in (
        licences.licences(docs, model=model), pii.pseudonymised(docs, "k"), linededup.dedup_lines(docs, n_lines="n_lines", n_dropped="n_dropped"), quality.quality(docs), pieces.encoded(docs),
    ):
        assert out.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in out.columns}) == len(out.columns)
        got = out.collect()
        assert len(got) == n and all(own(r) == own(docs.first()) for r in got)
    for out in (minhash.kept_documents(docs), mixing.mixed(docs, mixing.Mix(share=1.0)), quality.good_documents(docs)):
        assert out.columns == docs.columns and all(own(r) == own(docs.first()) for r in out.collect())
    assert minhash.near_duplicates(docs).count() == sharding.interleaved(docs).count() == media.read_media(*media.stored_media(docs)).count() == n
    assert order.materialised(docs, layout=order.Layout(length=64))[1] >= 1


STAGES = dict(corpus_pipeline.STAGES)
#: Odd rows that pass the quality rules beside those that don't.
PROSE = " ".join(f"noun{i % 83} verb{i % 71}" for i in range(90))
ROWS = [*ODD, (20, PROSE), (21, PROSE), (21, PROSE), (22, PROSE + "\n" + "a line that others have too"), (22, LONG + "\na line that others have too"), (None, PROSE), (23, PROSE, None, None)]


def test_quality_stage(spark):
    got = STAGES["quality_rules"](spark, frame(spark, ROWS), SF)
    assert got.columns == frame(spark, []).columns
    texts = [r.text for r in got.collect()]
    assert all(t is not None and not plain_quality(t)[-1] for t in texts) and {PROSE} <= set(texts)
    assert STAGES["quality_rules"](spark, frame(spark, []), SF).count() == 0


def test_line_stage(spark):
    got = STAGES["line_dedup"](spark, frame(spark, ROWS), SF)
    assert got.columns == frame(spark, []).columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == sorted([(i, t) for i, _, _, t in brute_lines(ROWS)], key=str)
    assert all(r.n_chars == len(r.text) for r in got.collect()) and STAGES["line_dedup"](spark, frame(spark, []), SF).count() == 0


def test_near_stage(spark):
    got = STAGES["near_dedup"](spark, frame(spark, ROWS), SF)
    kept = {(r.doc_id, r.text) for r in got.collect()}
    assert got.columns == frame(spark, []).columns
    assert {(20, PROSE), (None, PROSE), (1, None), (2, ""), (4, LONG)} <= kept and not {(21, PROSE), (23, PROSE)} & kept
    assert not any(i == 22 for i, _ in kept)  # near copies of 20 and 4
    assert STAGES["near_dedup"](spark, frame(spark, []), SF).count() == 0


def test_mix_stage(spark):
    docs = frame(spark, ROWS)
    got = STAGES["mix_sources"](spark, docs, SF)
    out = got.collect()
    n = lambda t: len((t or "").split())
    assert got.columns == docs.columns and all(n(r.text) for r in out) and sum(n(r.text) for r in out) <= 0.8 * sum(n(r[1]) for r in ROWS)
    assert len({(r.doc_id, r.text, r.lang, r.source) for r in out}) == len(out) - sum(r.doc_id == 21 for r in out) // 2 - sum(r.doc_id == 6 for r in out) // 2
    assert STAGES["mix_sources"](spark, frame(spark, []), SF).count() == 0
    assert fill([1], [1.0], 5) == [1.0]


def test_piece_stage(spark):
    got = STAGES["sentencepiece"](spark, frame(spark, ROWS), SF).collect()
    p = pieces.pieces(pieces.default_model())
    assert sorted([(r.doc_id, p.decode(r.ids)) for r in got], key=str) == sorted([(r[0], r[1] or "") for r in ROWS], key=str) and all(r.round_trip for r in got)
    assert STAGES["sentencepiece"](spark, frame(spark, []), SF).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    plain = {r.doc_id: r.text for r in docs.collect()}
    kept = good.collect()
    assert 0.5 < len(kept) / len(plain) < 1 and all(not plain_quality(r.text)[-1] for r in kept) and good.columns == docs.columns
    rows_in = [(r.doc_id, r.text) for r in kept]
    lines = corpus_pipeline.line_dedup(spark, good, SF)
    got = [(r.doc_id, r.text) for r in lines.collect()]
    assert sorted(got) == sorted((i, t) for i, _, _, t in brute_lines(rows_in)) and lines.columns == docs.columns
    near = corpus_pipeline.near_dedup(spark, lines, SF)
    kept = {i for i, v in brute_near(got, 5).items() if v[2]}
    assert {r.doc_id for r in near.collect()} == kept and near.columns == docs.columns
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {r.doc_id for r in out} <= kept and all(r.round_trip for r in out)
