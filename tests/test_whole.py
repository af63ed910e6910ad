"""Queries read whole tables and whole texts."""

import re

import pytest

from parlance.plans import registry

from .conftest import SF


def got(spark, name):
    return registry.QUERIES[name](spark, SF).toPandas()


def test_every_call_gets_its_event(spark):
    ids = spark.read.parquet(f"{SF}/orders.parquet").toPandas().o_orderkey
    assert ids.max() >= 200 and sorted(got(spark, "export_ics").call_id) == sorted(ids)


def test_a_call_beyond_the_first_fifty_is_found(spark):
    assert list(got(spark, "call_by_external_id").id) == [254]


def plain_degenerate(text):
    ws = text.split()
    plain = {re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() for w in ws}
    return len(ws) >= 4 and 3 * len(plain) <= len(ws)


def test_whole_documents_are_judged(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    flags = {r.doc_id: r.degenerate for r in got(spark, "degenerate_text").itertuples()}
    assert flags == {i: plain_degenerate(t) for i, t in texts.items()}
    assert any(f and not plain_degenerate(texts[i].split("\n")[-1]) for i, f in flags.items())


def test_rare_terms_have_postings(spark):
    p = got(spark, "fts_postings")
    df = p.groupby(["column", "term"]).call_id.nunique()
    assert df.min() == 1 and (df < 20).sum() > (df >= 20).sum()
    assert list(p.columns) == ["call_id", "column", "term", "tf", "first_pos"] and not p.duplicated(["call_id", "column", "term"]).any()


@pytest.mark.parametrize("name, column", [("normalize_text", "text"), ("html_strings", "html")])
def test_later_lines_are_read(spark, name, column):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = got(spark, name).set_index("call_id")[column]
    last = {i: re.findall(r"[A-Za-z]+", t.split("\n")[-1])[-1:] for i, t in texts.items() if "\n" in t}
    assert sum(map(bool, last.values())) > 100 and all(w in out[i] for i, ws in last.items() for w in ws)
    assert set(out.index) == set(texts)


def test_phrases_follow_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    flags = got(spark, "foreign_script").set_index("doc_id").foreign
    assert all(flags[i] == (i % 5 == 0 and 4 > 0.02 * (4 + sum(map(str.isalpha, t)))) for i, t in texts.items())
    assert set(got(spark, "detect_direction").direction) == {"ltr", "rtl"} and set(got(spark, "detect_script_language").call_id) == set(texts)
