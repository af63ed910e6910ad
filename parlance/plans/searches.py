"""Searches in a kept, segmented index that has been filled, corrected, retitled, thinned and merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import index as I
from parlance.operators import segmented as G
from parlance.operators.calls import DisplayFilter
from parlance.operators.search import MARKED, PLAIN
from parlance.sources import views as V
from parlance.sources.scratch import scratch
from parlance.sources.views import NOW, sql

QUERY, COVERED, LISTED = "thanti cafe place7", "on than*", "place7"
#: Each application's indexes, by the folder of the tables.
_KEPT: dict[tuple[str, str], G.Segmented] = {}


def kept(s, d) -> G.Segmented:
    """The index of the documents, made at the first call and opened by the others.

    A first part, a second one, entries whose text was wrong at first, new
    titles, deleted entries; then the small segments are merged.
    """
    key = s.sparkContext.applicationId, d
    if key not in _KEPT:
        rows, index = I.entries(V.index_rows(s, d)), G.Segmented(s, f"{scratch(s)}/segmented")
        wrong = F.when(F.col("call_id") % 10 == 4, F.lit("thanti place7 not yet right")).otherwise(F.col("transcript"))
        index.replaced(rows.where("call_id % 10 <> 3").withColumn("transcript", wrong))
        index.replaced(rows.where("call_id % 10 = 3"))
        index.replaced(rows.where("call_id % 10 = 4"))
        index.retitled(rows.where("call_id % 100 = 7").select("call_id", F.lit("Another cafe").alias("title")))
        index.without(rows.where("call_id % 100 = 9"))
        index.merged(most=3)
        _KEPT[key] = index
    return _KEPT[key]


def _calls(s, d):
    return V.calls(s, d)


def _display(s, d):
    return kept(s, d).display(V.calls(s, d), V.transcripts(s, d).select("call_id", "primary_language"), DisplayFilter(status="completed", text=LISTED, limit=20, offset=1), NOW)


QUERIES = {
    "kept_index": lambda s, d: kept(s, d).postings().groupBy("column").agg(F.count("*").alias("postings"), F.sum(F.size("positions")).alias("tf"), F.sum(F.length("term")).alias("letters")),
    "kept_search": lambda s, d: kept(s, d).ranked(QUERY).withColumn("score", F.round("score", 6)),
    "kept_frequency_rank": lambda s, d: kept(s, d).rank_by_frequency(QUERY).withColumn("score", F.round("score", 6)),
    "kept_covers": lambda s, d: kept(s, d).covers(COVERED),
    "kept_cover_rank": lambda s, d: kept(s, d).rank_by_covers(COVERED).withColumn("score", F.round("score", 6)),
    "kept_page": lambda s, d: kept(s, d).page(V.calls(s, d), QUERY, (F.col("status") == "completed") & (F.col("direction") != "unknown"), 20, 2).select("call_id", "title", "summary", "score"),
    "kept_display_page": lambda s, d: _display(s, d)[0].select("id", "external_id", "primary_language"),
    "kept_display_total": lambda s, d: _display(s, d)[1],
    "asked_question": lambda s, d: G.asked(kept(s, d), V.calls(s, d), QUERY, 3).select(F.length("context").alias("letters"), "answer", F.array_join(F.transform("citations", lambda c: c["call_id"].cast("string")), ",").alias("cited")),
    "densest_snippet": lambda s, d: G.snippets(V.search_documents(s, d).select("call_id", F.col("transcript").alias("text")), COVERED),
}

_FOLD = "translate(lower({0}), '" + MARKED + "', '" + PLAIN + "')"
_ROWS = "r AS (SELECT * REPLACE (CASE WHEN call_id % 100 = 7 THEN 'Another cafe' ELSE title END AS title) FROM index_rows WHERE call_id % 100 <> 9)"
_FLAT = "flat AS (" + " UNION ALL ".join(f"SELECT call_id, '{c}' AS \"column\", regexp_extract_all({_FOLD.format(c)}, '[\\p{{L}}\\p{{N}}]+') AS terms FROM r" for c in I.COLUMNS) + ")"
_BASE = (V.INDEX_ROWS, _ROWS, _FLAT)
_TERMS = ("thanti", "cafe", "place7")
_TF = ", ".join(f"sum(len(list_filter(terms, lambda t: starts_with(t, '{p}')))) AS tf{i}" for i, p in enumerate(_TERMS))
_DF = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(3))
_SCORE = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in range(3))
_HITS = f"""c AS (SELECT call_id, sum(len(terms)) AS dl, {_TF} FROM flat GROUP BY 1),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {_DF} FROM c),
hits AS (SELECT call_id, round({_SCORE}, 6) AS score FROM c, s WHERE tf0 > 0 OR tf1 > 0 OR tf2 > 0)"""
_COVERS = """spots AS (SELECT call_id, "column", pos, t = 'on' OR starts_with(t, 'on') AS p0, starts_with(t, 'than') AS p1 FROM (SELECT call_id, "column", unnest(terms) AS t, unnest(range(len(terms))) AS pos FROM flat) WHERE starts_with(t, 'on') OR starts_with(t, 'than')),
lasts AS (SELECT *, row_number() OVER w AS k, least(max(CASE WHEN p0 THEN pos END) OVER w, max(CASE WHEN p1 THEN pos END) OVER w) AS first, max(CASE WHEN p0 THEN pos END) OVER w IS NOT NULL AND max(CASE WHEN p1 THEN pos END) OVER w IS NOT NULL AS met
  FROM spots WINDOW w AS (PARTITION BY call_id, "column" ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT call_id, "column", first, min(pos) AS last, min(k) AS k FROM lasts WHERE met GROUP BY ALL),
covers AS (SELECT e.call_id, e."column", e.first::INTEGER AS first, e.last::INTEGER AS last, e.k - b.k + 1 AS hits FROM ends e JOIN lasts b ON b.call_id = e.call_id AND b."column" = e."column" AND b.pos = e.first)"""
_PAGE = "SELECT call_id, score, created_at FROM hits JOIN calls ON id = call_id WHERE status = 'completed' AND direction <> 'unknown' ORDER BY score DESC, created_at DESC, call_id LIMIT 20 OFFSET 2"
_WANTED = f"status = 'completed' AND (external_id LIKE '%{LISTED}%' OR id IN (SELECT call_id FROM flat WHERE len(list_filter(terms, lambda t: starts_with(t, '{LISTED}'))) > 0))"
_LANGUAGE = "l AS (SELECT call_id AS id, primary_language FROM transcripts)"
_HIT = "(starts_with({0}, 'on') OR starts_with({0}, 'than'))"
_PLAIN = "regexp_extract(" + _FOLD.format("x") + ", '[\\p{L}\\p{N}]+')"

SQL = {
    "kept_index": sql(*_BASE, body='SELECT "column", count(*) AS postings, sum(tf)::BIGINT AS tf, sum(length(term))::BIGINT AS letters FROM (SELECT call_id, "column", term, count(*) AS tf FROM (SELECT call_id, "column", unnest(terms) AS term FROM flat) GROUP BY ALL) GROUP BY 1'),
    "kept_search": sql(*_BASE, _HITS, body="SELECT * FROM hits"),
    "kept_frequency_rank": sql(*_BASE, "w AS (SELECT call_id, t, count(*) AS tf FROM (SELECT call_id, unnest(terms) AS t FROM flat) GROUP BY ALL)", "m AS (SELECT *, " + " + ".join(f"starts_with(t, '{p}')::INT" for p in _TERMS) + " AS times FROM w)", body="SELECT call_id, round(sum(0.1 * times * list_sum(list_transform(range(1, least(tf, 256) + 1), lambda j: 1 / (j * j))) / 1.64493406685) / 3, 6) AS score FROM m WHERE times > 0 GROUP BY 1"),
    "kept_covers": sql(*_BASE, _COVERS, body="SELECT * FROM covers"),
    "kept_cover_rank": sql(*_BASE, _COVERS, body="SELECT call_id, round(sum(0.1 / (1 + (last - first + 1 - hits))), 6) AS score FROM covers GROUP BY 1"),
    "kept_page": sql(*_BASE, _HITS, V.CALLS, f"p AS ({_PAGE})", body="SELECT call_id, title, summary, score FROM p JOIN r USING (call_id)"),
    "kept_display_page": sql(*_BASE, V.CALLS, V.TRANSCRIPTS, _LANGUAGE, body=f"SELECT id, external_id, primary_language FROM calls LEFT JOIN l USING (id) WHERE {_WANTED} ORDER BY is_favorite DESC, created_at DESC, id LIMIT 20 OFFSET 1"),
    "kept_display_total": sql(*_BASE, V.CALLS, body=f"SELECT count(*) AS total FROM calls WHERE {_WANTED}"),
    "densest_snippet": sql(V.SEARCH, "q AS (SELECT call_id, regexp_extract_all(transcript, '\\S+') AS ws FROM search_documents)", f"u AS (SELECT call_id, len(ws) AS n, unnest(range(len(ws))) AS pos, unnest(list_transform(ws, lambda x: {_PLAIN})) AS t FROM q)",
        f"h AS (SELECT *, count(*) OVER (PARTITION BY call_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 14 FOLLOWING) AS k FROM u WHERE {_HIT.format('t')})",
        "b AS (SELECT call_id, k AS n_hits, greatest(least(pos, n - 15), 0) AS s FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY k DESC, pos) AS r FROM h) WHERE r = 1)",
        body=f"SELECT call_id, CASE WHEN s > 0 THEN '...' ELSE '' END || array_to_string(list_transform(ws[s + 1:s + 15], lambda x: CASE WHEN {_HIT.format(_PLAIN)} THEN '<b>' || x || '</b>' ELSE x END), ' ') || CASE WHEN s + 15 < len(ws) THEN '...' ELSE '' END AS snippet, n_hits FROM b JOIN q USING (call_id)"),
}
