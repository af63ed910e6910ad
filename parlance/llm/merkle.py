"""Merkle manifest: a digest of every row, a tree for each group, a root of all, and every row's proof.

A group's leaves stand in the order of their ids. Aligned blocks of leaves are
reduced to their roots, these in blocks to theirs, until each group has one
node, its subroot; the subroots, by group, are the leaves of a last tree. On
the way down a block's paths come from a Merkle traversal: for each height a
treehash stack prepares the next authentication node while leaves are handed
out one by one, so that a block needs a node for each height and stacks of
logarithmic size besides its leaves. The path above a block is the same for
all its leaves and is appended.

No task gets more than a block at a time, no group is gathered anywhere, and
the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, partitions, removed, written


@dataclass(frozen=True)
class Layout:
    """Leaves of a block (a power of two of ``block_bits``), rows of a partition, rows of a table that may be sent to all tasks."""

    block_bits: int = 10
    rows: int = 250_000
    sent_rows: int = 100_000


LAYOUT = Layout()
#: A level of a proof: the sibling's digest (null: the node is alone) and whether it stands on the left.
PROOF = "array<struct<sibling: string, left: boolean>>"
_PROOF = pa.list_(pa.struct([("sibling", pa.string()), ("left", pa.bool_())]))


def leaf_of(*columns: str | Column) -> Column:
    """The digest of a row: of each column its bytes' count, a colon and its value as text; a null is a hyphen."""
    text = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def parent(left: str | None, right: str | None) -> str | None:
    """The digest of a run of two nodes, or of one; None where there is no node."""
    return None if left is None else sha256((left + (right or "")).encode()).hexdigest()


def height_of(n: int, bits: int) -> int:
    """The levels from a block of a level of ``n`` nodes to its root: fewer only if the level is one block."""
    return bits if n > 1 << bits else max(n - 1, 0).bit_length()


def subtree(leaves: Sequence[str], at: int, height: int) -> str | None:
    """The node of ``height`` above the leaves from ``at`` on, by treehash; None if there are none."""
    stack: list[tuple[int, str]] = []
    for leaf in leaves[at : at + (1 << height)]:
        node = 0, leaf
        while stack and stack[-1][0] == node[0]:
            node = node[0] + 1, parent(stack.pop()[1], node[1])
        stack.append(node)
    if not stack:
        return None
    level, node = stack.pop()
    while level < height:
        left = stack.pop()[1] if stack and stack[-1][0] == level else None
        level, node = level + 1, parent(node, None) if left is None else parent(left, node)
    return node


class Treehash:
    """The node of ``height`` above the leaves from ``at`` on, a step at a time."""

    def __init__(self, leaves: Sequence[str], height: int, at: int, done: bool = False) -> None:
        self.leaves, self.height, self.at, self.done = leaves, height, at, done
        self.stack: list[tuple[int, str | None]] = []

    def low(self) -> float:
        """Where the next step happens: the height of the lowest node; none if all is done."""
        return float("inf") if self.done else self.stack[-1][0] if self.stack else self.height

    def step(self) -> None:
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            level, right = stack.pop()
            stack[-1] = level + 1, parent(stack[-1][1], right)
        else:
            stack.append((0, self.leaves[self.at] if self.at < len(self.leaves) else None))
            self.at += 1
        self.done = len(stack) == 1 and stack[0][0] == self.height

    def node(self) -> str | None:
        return self.stack[0][1]


def traversal(leaves: Sequence[str], height: int) -> Iterator[list[tuple[str | None, bool]]]:
    """Each leaf's path to the root of its block, leaf by leaf: (sibling, whether it is on the left).

    Logarithmic scheduling: after each leaf 2 * height - 1 steps go to the stack
    whose next step is lowest, which has every node ready when it is due.
    """
    auth = [subtree(leaves, 1 << j, j) for j in range(height)]
    stacks, node = [], leaves[0]
    for j in range(height):
        first = Treehash(leaves, j, 0, done=True)
        first.stack = [(j, node)]
        stacks.append(first)
        node = parent(node, auth[j])
    for s in range(len(leaves)):
        yield [(auth[j], bool(s >> j & 1)) for j in range(height)]
        for j in range(height):
            if (s + 1) & ((1 << j) - 1):
                break
            auth[j] = stacks[j].node()
            start = (s + 1 + (1 << j)) ^ (1 << j)
            stacks[j] = Treehash(leaves, j, start, done=start >= len(leaves))
            if stacks[j].done:
                stacks[j].stack = [(j, None)]
        for _ in range(2 * height - 1):
            lows = [x.low() for x in stacks]
            least = min(lows)
            if least == float("inf"):
                break
            stacks[lows.index(least)].step()


def _placed(rows: DataFrame, order: list[str], layout: Layout) -> DataFrame:
    """``rows`` (g, node, row) as (g, rank, n, node, row): a node's place in its group, and the group's size.

    A range partitioning by group, order and digest; equal rows go by their
    place in the written table, so that they too are spread.
    """
    spark = rows.sparkSession
    table = written(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    parts = max(partitions(spark), table.count() // layout.rows)
    keys = ["g", *order, "node", "tie"]
    at = F.col("at")
    ranged = table.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ranged = written(ranged.select("g", "node", "row", F.shiftright(at, 33).cast("int").alias("pid"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ranged")
    removed(table)
    runs = ranged.groupBy("g", "pid").agg(F.count("at").alias("k"), F.min("at").alias("first"))
    of = Window.partitionBy("g")
    before = F.sum("k").over(of.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k")
    runs = written(runs.select("g", "pid", (before - F.col("first")).alias("shift"), F.sum("k").over(of).alias("n")), "runs")
    few = runs.count() <= layout.sent_rows
    return ranged.join(F.broadcast(runs) if few else runs, ["g", "pid"]).select("g", (F.col("at") + F.col("shift")).alias("rank"), "n", "node", "row")


def _levels(nodes: DataFrame, layout: Layout) -> list[DataFrame]:
    """``nodes`` and the levels above it, up to one node for each group; one level at least."""
    spark, bits = nodes.sparkSession, layout.block_bits

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        n, rank = table["n"][0].as_py(), table["rank"][0].as_py()
        top = subtree(table["node"].to_pylist(), 0, height_of(n, bits))
        return pa.table({"g": table["g"][:1], "rank": [rank >> bits], "n": [-(-n >> bits)], "node": [top]})

    levels, rows = [nodes], nodes.count()
    most = nodes.agg(F.max("n")).first()[0] or 0
    while len(levels) == 1 or most > 1:
        blocks = levels[-1].select("g", "rank", "n", "node", _block(bits)).repartition(max(partitions(spark), rows // layout.rows), "g", "block")
        up = blocks.groupBy("g", "block").applyInArrow(run, "g string, rank bigint, n bigint, node string")
        levels.append(written(up, f"level{len(levels)}").withColumn("row", F.lit(None).cast("int")))
        most, rows = -(-most >> bits), -(-rows >> bits)
    return levels


def _block(bits: int) -> Column:
    return F.shiftright("rank", bits).alias("block")


def _descended(nodes: DataFrame, above: DataFrame, layout: Layout) -> DataFrame:
    """(g, rank, row, node, path, subroot, root) of ``nodes``, from the paths of the level ``above`` (g, rank, path, subroot, root)."""
    spark, bits = nodes.sparkSession, layout.block_bits
    kind = nodes.schema["row"].dataType
    own = nodes.select("g", _block(bits), "rank", "n", "node", "row", *[F.lit(None).cast(t).alias(c) for c, t in (("path", PROOF), ("subroot", "string"), ("root", "string"))])
    heads = above.select("g", F.col("rank").alias("block"), F.lit(-1).cast("bigint").alias("rank"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("node"), F.lit(None).cast(kind).alias("row"), "path", "subroot", "root")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        head, rows = table.slice(0, 1), table.slice(1)
        upper = [(x["sibling"], x["left"]) for x in head["path"][0].as_py()]
        siblings, lefts, ends = [], [], [0]
        for path in traversal(rows["node"].to_pylist(), height_of(rows["n"][0].as_py(), bits)):
            for sibling, left in path + upper:
                siblings.append(sibling)
                lefts.append(left)
            ends.append(len(lefts))
        entries = pa.StructArray.from_arrays([pa.array(siblings, pa.string()), pa.array(lefts, pa.bool_())], fields=list(_PROOF.value_type))
        consts = [pa.repeat(head[c][0], rows.num_rows) for c in ("subroot", "root")]
        return pa.table([rows["g"], rows["rank"], rows["row"], rows["node"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries), *consts], names=["g", "rank", "row", "node", "path", "subroot", "root"])

    n = max(partitions(spark), nodes.count() // layout.rows)
    blocks = own.unionByName(heads).repartition(n, "g", "block").groupBy("g", "block")
    return blocks.applyInArrow(run, f"g string, rank bigint, row {kind.simpleString()}, node string, path {PROOF}, subroot string, root string")


def proofs(leaves: DataFrame, leaf: str, order: list[str], group: str, layout: Layout = LAYOUT) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``proof`` (PROOF, from the leaf's level to the root's).

    ``leaf`` names the column of digests (hexadecimal text). In each ``group``
    the rows stand by ``order``, nulls first; equal ones by digest. While a level
    has several nodes, every two consecutive ones become the digest of both, a
    last one that of itself. The subroots, by group (null first, bytewise), are
    the leaves of the last tree. Repeated rows are leaves of their own; an empty
    table gives an empty one. All columns of ``leaves`` pass through and are
    shuffled twice, so leave large ones out; the new columns get a number where
    there is one of their name.
    """
    names = leaves.columns
    g = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    inner = [f"c{i}" for i in range(len(names))]
    row = F.struct(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, inner, strict=True)])
    keys = [f"row.c{names.index(c)}" for c in order]
    levels = _levels(_placed(leaves.select(g.alias("g"), F.col(f"`{leaf}`").alias("node"), row.alias("row")), keys, layout), layout)
    tops = _levels(_placed(levels[-1].select(F.lit("").alias("g"), "node", F.struct("g").alias("row")), ["row.g"], layout), layout)

    empty = F.array().cast(PROOF)
    path = tops[-1].select("g", "rank", empty.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    for nodes in reversed(tops[:-1]):
        path = _descended(nodes, path, layout)
    path = path.select(F.col("row.g").alias("g"), F.lit(0).cast("bigint").alias("rank"), "path", F.col("node").alias("subroot"), "root")
    for nodes in reversed(levels[:-1]):
        path = _descended(nodes, path, layout)
    subroot, root, proof = fresh(names, "subroot", "root", "proof")
    return path.select(*[F.col(f"row.{k}").alias(c) for c, k in zip(names, inner, strict=True)], F.col("subroot").alias(subroot), F.col("root").alias(root), F.col("path").alias(proof))


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), order: Sequence[str] = ("doc_id",), group: str = "lang", keep: Sequence[str] = (), layout: Layout = LAYOUT) -> DataFrame:
    """Of each row of ``docs``: ``order``, ``group`` and ``keep``, its ``leaf``, and what ``proofs`` adds.

    The leaf is the digest of ``columns``: a null differs from an empty text,
    and a text of any length is digested whole. Only the columns named here are
    shuffled, never the texts.
    """
    names = list(dict.fromkeys([*order, group, *keep]))
    (leaf,) = fresh(names, "leaf")
    quoted = [F.col(f"`{c}`") for c in columns]
    return proofs(docs.select(*[F.col(f"`{c}`") for c in names], leaf_of(*quoted).alias(leaf)), leaf, list(order), group, layout)


def folded(leaf: str | Column, proof: str | Column) -> Column:
    """The root that a leaf and a proof lead to; null without a proof."""
    leaf, proof = (F.col(c) if isinstance(c, str) else c for c in (leaf, proof))
    return F.aggregate(proof, leaf, lambda acc, x: F.sha2(F.when(x["left"], F.concat(F.coalesce(x["sibling"], F.lit("")), acc)).otherwise(F.concat(acc, F.coalesce(x["sibling"], F.lit("")))), 256))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """``manifest`` over all documents, and each row's proof applied to it, to a tampered row where 7 divides the id's CRC-32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).alias("n_chars")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf_of("doc_id", "source", "lang", more, "text"))
    rows = manifest(docs.withColumn("tampered", tampered), keep=["tampered"])
    siblings = F.array_join(F.transform("proof", lambda x: x["sibling"]), "")
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), "proof").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


_NIBBLE = "xor({0} >> 4, crc[({0} & 15) + 1])"
_STEP = _NIBBLE.format("xor(c, b)")
_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
#: The query in SQL: all levels by recursion, a row's siblings by its place, the fold by recursion. A CRC-32 goes over the digits in half bytes.
OP13_SQL = rf"""
WITH RECURSIVE
t AS (SELECT list(c ORDER BY i) AS crc FROM (
  SELECT i, list_reduce(list_concat([i], range(4)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(16) r(i))),
d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format("n_chars")} AS leaf, {_LEAF.format("(n_chars::HUGEINT + 1)")} AS changed,
    list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda p: ('0x' || p)::BIGINT)) AS bytes FROM documents),
r AS (
  SELECT d.*, CASE WHEN xor(list_reduce(bytes, lambda c, b: {_NIBBLE.format(f"({_STEP})")}), 4294967295) % 7 = 0 THEN changed ELSE leaf END AS start,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM d, t),
up AS (
  SELECT g, 0 AS level, rank AS pos, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM r
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY g, level, pos // 2),
sub AS (SELECT g, node AS subroot, level AS top, row_number() OVER (ORDER BY g) - 1 AS place FROM up WHERE n = 1),
high AS (
  SELECT 0 AS level, place AS pos, subroot AS node, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, pos // 2),
p AS (
  SELECT r.doc_id, r.leaf, r.rank, r.g, u.level, (r.rank >> u.level) & 1 AS odd, s.node FROM r JOIN (SELECT DISTINCT g, level FROM up WHERE n > 1) u ON u.g = r.g
  LEFT JOIN up s ON s.g = r.g AND s.level = u.level AND s.pos = xor(r.rank >> u.level, 1)
  UNION ALL
  SELECT r.doc_id, r.leaf, r.rank, r.g, sub.top + h.level, (sub.place >> h.level) & 1, s.node FROM r JOIN sub ON sub.g = r.g CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) h
  LEFT JOIN high s ON s.level = h.level AND s.pos = xor(sub.place >> h.level, 1)),
proof AS (SELECT g, rank, coalesce(string_agg(node, '' ORDER BY level), '') AS siblings, list(struct_pack(odd := odd, node := coalesce(node, '')) ORDER BY level) AS path FROM p GROUP BY ALL),
fold AS (
  SELECT r.g, r.rank, 0 AS level, r.start AS acc, coalesce(path, []) AS path FROM r LEFT JOIN proof USING (g, rank)
  UNION ALL
  SELECT g, rank, level + 1, sha256(CASE WHEN path[level + 1].odd = 1 THEN path[level + 1].node || acc ELSE acc || path[level + 1].node END), path FROM fold WHERE level < len(path))
SELECT r.doc_id, r.leaf, sub.subroot, high.node AS root, sha256(coalesce(proof.siblings, '')) AS proof_sha256, fold.acc AS folded_root, fold.acc = high.node AS verified
FROM r JOIN sub USING (g) JOIN high ON high.n = 1 LEFT JOIN proof USING (g, rank) JOIN fold ON fold.g = r.g AND fold.rank = r.rank AND fold.level = len(fold.path)
"""
