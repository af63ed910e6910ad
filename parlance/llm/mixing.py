"""Mixing sources to target weights: hierarchical budgets, token-prefixes of seeded epochs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, written
from .sharding import hex_digits, running, seeded_key

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """What to mix: a budget, weights for the nodes of the tree, and how often a leaf may repeat.

    ``budget`` is in words, or with ``share`` set a share of all words there
    are. ``weights[level][name]`` is a node's weight among its siblings; a node
    not named has ``default``; null has the name ``None``.
    """

    share: float = 0.5
    budget: int | None = None
    max_epochs: int = 4
    seed: str = "mix-1"
    default: float = 1.0
    weights: Mapping[str, Mapping[str | None, float]] = field(default_factory=dict)


#: The mix of query and pipeline: web-like src0 against the curated rest, English first.
MIX = Mix(weights={"domain": {"bulk": 1.0, "curated": 3.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}})


def domain_of(source: Column) -> Column:
    """The query's domains: the hot source is ``bulk``, all others are ``curated``."""
    return F.when(source == "src0", "bulk").otherwise("curated")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _weight(level: str, mix: Mix) -> Column:
    named = mix.weights.get(level, {})
    out = F.lit(float(mix.default))
    for name, w in named.items():
        out = F.when(F.col(level).isNull() if name is None else F.col(level) == name, float(w)).otherwise(out)
    return out


def budgets(leaves: DataFrame, mix: Mix = MIX, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``budget`` of each leaf, from ``leaves`` with the columns ``levels`` and ``words`` (the supply).

    Top down, each parent's budget is filled into its children like water:
    child i gets min(capacity_i, lambda * weight_i), where the capacity is the
    supply of its whole subtree times ``max_epochs``. So what a node can't use
    goes to its siblings, and only what all of them together can't use is
    missing at the parent, whose own siblings then get it. Lambda comes from
    running sums over the children in order of capacity / weight. A weight of
    zero gives nothing. The unit is the word, not a tokenizer's token: native
    code can't tokenize, and a word count stands in proportion to it within a
    language. Leaves are few (the tree's size, not the corpus's);
    every sum is a window over one parent's children.
    """
    capacity = F.col("words") * F.lit(mix.max_epochs)
    total = Window.partitionBy()
    target = F.lit(float(mix.budget)) if mix.budget is not None else F.lit(float(mix.share)) * F.sum("words").over(total)
    nodes = leaves.select(*levels, "words", capacity.cast("double").alias("cap"), F.floor(target).cast("double").alias("given"))
    for depth in range(1, len(levels) + 1):
        path, parent = list(levels[:depth]), list(levels[: depth - 1])
        node = nodes.groupBy(*path).agg(F.sum("cap").alias("c"), F.max("given").alias("b")).withColumn("w", _weight(levels[depth - 1], mix)).where("c > 0 AND w > 0")
        fill = F.col("c") / F.col("w")
        order = Window.partitionBy(*parent).orderBy(fill, *[F.col(x).asc_nulls_first() for x in path])
        over = Window.partitionBy(*parent)
        done = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1))
        left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        # the level if this child and all after it were not full: it rises while children fill up and sinks from the first that doesn't
        node = node.withColumn("level", (F.col("b") - F.coalesce(done, F.lit(0.0))) / left).withColumn("fill", fill)
        node = node.withColumn("lam", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(over))
        node = node.select(*[F.col(x).alias(f"n_{x}") for x in path], F.when(F.col("lam").isNull(), F.col("c")).otherwise(F.least("c", F.col("lam") * F.col("w"))).alias("got"))
        same = F.lit(True)
        for x in path:
            same = same & F.col(x).eqNullSafe(F.col(f"n_{x}"))
        nodes = nodes.join(node, same, "left").select(*levels, "words", "cap", F.coalesce("got", F.lit(0.0)).alias("given"))
    return nodes.select(*levels, "words", F.floor(F.col("given") + 1e-6).cast("bigint").alias("budget"))


def chosen(docs: DataFrame, mix: Mix = MIX, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Every document's id and text hash with its leaf, words, and in how many epochs it is taken (``copies``, often 0).

    A leaf whose budget is e supplies and a rest takes all its rows e times
    and, in epoch e, the longest prefix of that epoch's seeded order that fits
    into the rest. Rows without words are never taken. Null languages and
    sources are leaves of their own. Rows that repeat id, text and leaf are one
    document: their words add up and they are taken together. Equal keys of the
    seeded order go by id, then by text hash. A very long text counts with all
    its words, so one that is longer than its leaf's rest is never in a prefix.
    Other columns, whatever their names, aren't looked at. An empty table gives
    none.
    """
    domain = domain_of(F.col(source_col)) if domain is None else domain
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("th"),
        domain.cast("string").alias("domain"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("words"),
    )
    rows = written(rows.groupBy("id", "th", *LEVELS).agg(F.sum("words").alias("words")), "rows")
    leaf = F.concat_ws("", *[F.coalesce(F.concat(F.lit("="), F.length(x).cast("string"), F.lit(":"), F.col(x)), F.lit("-")) for x in LEVELS])
    rows = rows.withColumn("leaf", leaf)
    supply = rows.groupBy("leaf", *LEVELS).agg(F.sum("words").alias("words"))
    plan = budgets(supply.drop("leaf"), mix).withColumn("leaf", leaf)
    plan = written(plan.select("leaf", "budget", F.col("words").alias("supply"), F.when(F.col("words") > 0, F.call_function("div", F.col("budget"), F.col("words"))).otherwise(F.lit(0)).cast("bigint").alias("full")), "plan")
    rows = rows.join(plan, "leaf").withColumn("rest", F.col("budget") - F.col("full") * F.col("supply"))
    rows = rows.withColumn("key", seeded_key(mix.seed, F.col("full"), F.col("id")))
    rows = rows.withColumn("bucket", F.conv(F.substring("key", 1, hex_digits(rows.count())), 16, 10).cast("int"))
    taken = running(rows, ["leaf"], "bucket", [F.col("key"), F.col("id"), F.col("th"), F.col("words")], F.col("words"))
    copies = F.when(F.col("words") == 0, 0).otherwise(F.col("full") + F.when(F.col("before") + F.col("words") <= F.col("rest"), 1).otherwise(0))
    return taken.select("id", "th", *LEVELS, "words", "key", "before", copies.cast("int").alias("copies"))


def mixed(docs: DataFrame, mix: Mix = MIX, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` itself with every row as often as the mix takes it; the columns are those of ``docs``.

    Rows are told apart by id, text and leaf, as in ``chosen``, which says what
    nulls, ties, repeated rows, very long texts, texts without words and an
    empty table give. Columns of any name pass through.
    """
    names = fresh(docs.columns, "key", "th", "d", "l", "s", "copies", "epoch")
    key, th, d, lang, src, copies, epoch = names
    take = chosen(docs, mix, domain, id_col, text_col, lang_col, source_col).where("copies > 0")
    take = take.select(*[F.col(x).alias(y) for x, y in zip(("id", "th", *LEVELS, "copies"), names, strict=False)])
    domain = domain_of(F.col(source_col)) if domain is None else domain
    on = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text_col)) == F.col(th))
    for mine, other in ((domain, d), (F.col(lang_col), lang), (F.col(source_col), src)):
        on = on & mine.cast("string").eqNullSafe(F.col(other))
    return docs.join(take, on).withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """``chosen`` over all documents: every document with its leaf, words and copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return chosen(docs).select(F.col("id").alias("doc_id"), "domain", "lang", "source", F.col("words").alias("n_words"), "copies")


def _fill_sql(depth: int) -> str:
    """One level of the budgets' water-filling, as SQL."""
    path = ", ".join(LEVELS[:depth])
    parent = f"PARTITION BY {', '.join(LEVELS[: depth - 1])}" if depth > 1 else ""
    level = LEVELS[depth - 1]
    cases = " ".join(f"WHEN {level} = '{k}' THEN {float(w)}" for k, w in MIX.weights.get(level, {}).items())
    weight = f"CASE {cases} ELSE {float(MIX.default)} END" if cases else f"{float(MIX.default)}"
    return f"""
  c{depth} AS (SELECT {path}, sum(cap) AS c, max(given) AS b, {weight}::DOUBLE AS w FROM g{depth - 1} GROUP BY {path} HAVING sum(cap) > 0),
  l{depth} AS (SELECT *, c / w AS fill, (b - coalesce(sum(c) OVER ({parent} ORDER BY c / w, {path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER ({parent} ORDER BY c / w, {path} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c{depth}),
  m{depth} AS (SELECT *, max(CASE WHEN lv <= fill THEN lv END) OVER ({parent}) AS lam FROM l{depth}),
  g{depth} AS (SELECT g.domain, g.lang, g.source, g.words, g.cap,
      coalesce(CASE WHEN lam IS NULL THEN c ELSE least(c, lam * w) END, 0) AS given
    FROM g{depth - 1} g LEFT JOIN m{depth} USING ({path}))"""


OP2_SQL = f"""
WITH d AS (
    SELECT doc_id, CASE WHEN source = 'src0' THEN 'bulk' ELSE 'curated' END AS domain, lang, source,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words
    FROM documents),
  s AS (SELECT domain, lang, source, sum(words)::BIGINT AS words FROM d GROUP BY ALL),
  g0 AS (SELECT *, (words * {MIX.max_epochs})::DOUBLE AS cap, floor({MIX.share} * sum(words) OVER ()) AS given FROM s),
  {",".join(_fill_sql(k) for k in (1, 2, 3))},
  p AS (SELECT domain, lang, source, words AS supply, floor(given + 1e-6)::BIGINT AS budget,
               CASE WHEN words > 0 THEN floor(given + 1e-6)::BIGINT // words ELSE 0 END AS epochs FROM g3),
  o AS (SELECT d.*, epochs, budget - epochs * supply AS rest, md5(concat('{MIX.seed}:', epochs, ':', doc_id)) AS k FROM d JOIN p USING (domain, lang, source)),
  r AS (SELECT *, sum(words) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id) AS upto FROM o)
SELECT doc_id, domain, lang, source, words AS n_words,
       (CASE WHEN words = 0 THEN 0 ELSE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END END)::INTEGER AS copies
FROM r
"""
