"""MinHash near-dedup: one-permutation hashing, optimal densification, bands, stars, exact confirmation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_table, filter_bits, fresh, places, removed, written

#: Bands and bins in a band. Two sets of Jaccard 0.8 share no band with a chance of (1 - 0.8 ** 6) ** 40 = 5e-6.
BANDS, ROWS = 40, 6
#: Parts that a hot bucket or group is cut into: bits of a long.
SALTS = 60
#: Documents of a bucket that are held against others in one part.
PART_ROWS = 512
#: Distinct words whose hashes a Python worker keeps.
WORDS_KEPT = 250_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to 64-bit hash; forgets all when it holds WORDS_KEPT words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text; a text shorter than ``width`` words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six blanks only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    size = min(n, width)
    out = np.full(n - size + 1, np.uint64(size))
    for k in range(size):
        out = mix(out + _M1) + h[k : n - size + 1 + k]
    return np.unique(mix(out))


@lru_cache(maxsize=4)
def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin its own random order of all bins, and each bin's rank in it."""
    i = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
    order = np.argsort(mix(i + _M1), axis=1, kind="stable").astype(np.int32)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(bins, dtype=np.int32)[None, :].repeat(bins, 0), 1)
    return order, rank


def signature(s: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signature of a non-empty sorted set.

    The 64-bit range is cut into ``bins`` equal bins; each holds its least
    hash. An empty bin takes the value of the first filled bin in its own
    random order of bins, the same for every document, so that two sets agree
    in a densified bin with their Jaccard similarity as in a filled one.
    """
    bin_of = ((s >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bin_of[1:] != bin_of[:-1])))
    at = bin_of[first]
    out, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[at], filled[at] = s[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order, rank = _orders(bins)
        for t in range(6):
            take = order[empty, t]
            ok = filled[take]
            out[empty[ok]] = out[take[ok]]
            empty = empty[~ok]
            if not len(empty):
                return out
        out[empty] = out[at[np.argmin(rank[empty][:, at], axis=1)]]
    return out


def bands(sig: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, different between bands."""
    x, key = sig.reshape(n_bands, rows), np.arange(n_bands, dtype=np.uint64) * _M1
    for k in range(rows):
        key = mix(key + _M1) + x[:, k]
    return mix(key).view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signed(width: int, n_bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            count, digest, keys, bits = [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), width)
                sig = signature(s, n_bands * rows) if len(s) else None
                count.append(len(s))
                digest.append(_digest(s) if len(s) else None)
                keys.append(bands(sig, n_bands, rows) if len(s) else None)
                bits.append(sketch(sig) if len(s) else None)
            node = pa.array(np.arange(number, number + batch.num_rows, dtype=np.int64))
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["id", "th", "node", "n", "digest", "bands", "sketch"])

    return run


#: Bits of the sketch that may differ, of BANDS * ROWS. At Jaccard 0.8 a bit differs with a chance of 0.1: 24 of 240, and over 50 with one of 1e-7.
SKETCH_LIMIT = 50 / 240


def sketch(sig: np.ndarray) -> list[int]:
    """One bit of each bin, scrambled with the bin's number, in 64-bit integers."""
    bit = (mix(sig + np.arange(len(sig), dtype=np.uint64) * _M2) & np.uint64(1)).astype(np.uint8)
    raw = np.packbits(bit)
    return np.frombuffer(raw.tobytes().ljust(-(-len(raw) // 8) * 8, b"\0"), np.int64).tolist()


def _sets(width: int, table: Broadcast):
    """(id, digest, elements) of the rows whose two bits are set in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value

        def made(ids: list, digests: list, sets: list, kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["id", "digest", "elements"])

        for batch in batches:
            kind = batch.schema.field(0).type
            wanted = np.ones(batch.num_rows, bool)
            for c in (2, 3):
                at = batch.column(c).to_numpy(zero_copy_only=False)
                wanted &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            ids, digests, sets, size = [], [], [], 0
            for k in np.flatnonzero(wanted).tolist():
                s = shingles(batch.column(1)[k].as_py(), width)
                ids.append(batch.column(0)[k].as_py())
                digests.append(_digest(s))
                sets.append(s.view(np.int64))
                size += len(s)
                if size > 500_000:
                    yield made(ids, digests, sets, kind)
                    ids, digests, sets, size = [], [], [], 0
            yield made(ids, digests, sets, kind)

    return run


def _salt(col: str):
    return F.pmod(F.xxhash64(col), F.lit(SALTS)).cast("int")


def _spread(df: DataFrame, mask: str = "mask") -> DataFrame:
    """A row for each salt in ``mask``."""
    return df.withColumn("salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.call_function("getbit", F.col(mask), s) == 1))).drop(mask)


def sets_of(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, elements), a written table: the full shingle sets of ``nodes`` (node, id, digest), one for each node.

    The texts are read again where they lie: a filter of bounded size tells
    the tasks which documents to shingle (some too many do no harm).
    """
    spark, kind = texts.sparkSession, texts.schema["id"].dataType
    wanted = written(nodes.select("node", "id", "digest").distinct(), "wanted")
    bits = filter_bits(wanted.count())
    table = bit_table(wanted.select(F.explode(F.array(*places(F.col("id"), bits))).alias("bit")), "bit", bits)
    schema = T.StructType([T.StructField("id", kind), T.StructField("digest", T.BinaryType()), T.StructField("elements", T.ArrayType(T.LongType()))])
    marked = texts.where("id IS NOT NULL").select("id", "text", *[p.alias(f"bit{k}") for k, p in enumerate(places(F.col("id"), bits))])
    sets = marked.mapInArrow(_sets(width, spark.sparkContext.broadcast(table)), schema)
    # an id may be on several rows, with other texts or with this one again
    found = written(sets.hint("merge").join(wanted, ["id", "digest"]).dropDuplicates(["node"]).select("node", "elements"), "sets")
    removed(wanted)
    return found


def _similar(a: str, b: str, threshold: int):
    """Whether 100 * intersection >= threshold * union, of two sets."""
    both = F.size(F.array_intersect(a, b)).cast("bigint")
    return F.lit(100) * both >= F.lit(threshold) * (F.size(a) + F.size(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (doc, hub) whose full sets reach the threshold.

    A hub's pairs are dealt out by the salt of the other end, and its set goes
    to the salts that it has.
    """
    spokes = pairs.hint("merge").join(sets.select(F.col("node").alias("doc"), "elements"), "doc").withColumn("salt", _salt("doc"))
    salts = _spread(pairs.withColumn("salt", _salt("doc")).groupBy("hub").agg(F.expr("bit_or(shiftleft(1L, salt))").alias("mask")))
    hubs = salts.hint("merge").join(sets.select(F.col("node").alias("hub"), F.col("elements").alias("of_hub")), "hub")
    return spokes.hint("merge").join(hubs, ["hub", "salt"]).where(_similar("elements", "of_hub", threshold)).select("doc", "hub")


def _alike(a: str, b: str, n_a: str, n_b: str, bins: int, threshold: int):
    """Whether two documents' sizes and sketches let their similarity reach the threshold."""
    differ = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(-(-bins // 64))), F.lit(0))
    return (differ <= int(SKETCH_LIMIT * bins)) & (F.lit(100) * F.least(n_a, n_b) >= F.lit(threshold) * F.greatest(n_a, n_b))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every end of ``edges`` (doc, hub).

    Rounds of least label among neighbours, then a jump to the label's own
    label. Each round's labels are a written table that replaces the last one's;
    none are sent to the driver.
    """
    both = written(edges.select(F.col("doc").alias("a"), F.col("hub").alias("b")).union(edges.select("hub", "doc")), "edges")
    now = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label"))
    table = written(now, "labels")
    while True:
        now = table.select("node", F.col("new" if "new" in table.columns else "label").alias("label"))
        near = both.join(now, F.col("a") == F.col("node")).groupBy(F.col("b").alias("n")).agg(F.min("label").alias("near"))
        step = now.join(near, F.col("node") == F.col("n")).select("node", "label", F.least("label", "near").alias("new"))
        jump = step.join(now.select(F.col("node").alias("j"), F.col("label").alias("via")), F.col("new") == F.col("j"), "left").select("node", "label", F.least("new", F.coalesce("via", "new")).alias("new"))
        last, table = table, written(jump, "labels")
        removed(last)
        if table.where("new <> label").isEmpty():
            removed(both)
            return table.select("node", "label")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id``, ``th`` (the text's hash), ``n_shingles``, ``component_id``, ``kept`` and ``component`` for every row of ``docs``.

    1. Each row is a node and gets its text's distinct ``width``-word shingles,
       their digest and the band keys of its signature. Rows with one digest
       are copies; only one of them goes on.
    2. In each bucket (band key) the least node is the hub; a node's candidates
       are its hubs, so a bucket of m nodes makes m - 1 pairs.
    3. Pairs whose sizes and sketches allow the similarity are confirmed on
       full sets; confirmed pairs make components.
    4. A bucket whose nodes then lie in several components may hide links
       between spokes that the hub doesn't have. There each node outside the
       bucket's largest component is held against those of all other
       components, by size and sketch, and by full sets in the first bucket
       that the two share, inside a join that only links come out of. This is
       the exact way for what stars can't see; it takes time with the square of
       such a bucket where nothing in it is linked.

    ``component_id`` is the least id of a component and ``kept`` says that the
    row has it. Texts without words have no shingles, a component of their own,
    and are kept. Rows that repeat an id with other texts are documents of
    their own; rows that repeat id and text are one document, kept or not
    together. A null id has a null component, links nothing and is kept. An
    empty table gives an empty one; other columns play no part.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("th", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])
    signed = written(texts.mapInArrow(_signed(width, n_bands, rows), schema), "signed")

    # copies: one node of each digest, found by salted groups; a null id has no part in it
    linked = F.col("digest").isNotNull() & F.col("id").isNotNull()
    salted = signed.where(linked).select("digest", "id", "node", _salt("node").alias("salt"))
    copies = salted.groupBy("digest").agg(F.min("id").alias("least"), F.min("node").alias("first"), F.max("node").alias("last"), F.expr("bit_or(shiftleft(1L, salt))").alias("mask"))
    copies = _spread(copies.where("first <> last").select("digest", "first", "least", "mask"))
    nodes = signed.withColumn("salt", F.when(linked, _salt("node")).otherwise(-1)).hint("merge").join(copies, ["digest", "salt"], "left")
    nodes = nodes.withColumn("rep", F.coalesce("first", "node")).withColumn("least", F.coalesce("least", "id"))
    own = F.when(linked & (F.col("rep") == F.col("node")), F.struct("digest", "bands", "sketch"))
    nodes = written(nodes.select("id", "th", "node", "n", "rep", "least", own.alias("own")), "nodes")
    removed(signed)

    # stars: the least node of each bucket
    reps = nodes.where("own IS NOT NULL").select("node", F.explode("own.bands").alias("bucket"), _salt("node").alias("salt"))
    hubs = reps.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.expr("bit_or(shiftleft(1L, salt))").alias("mask"))
    hubs = _spread(hubs.where("hub <> last").drop("last"))
    stars = written(reps.hint("merge").join(hubs, ["bucket", "salt"]).select("bucket", "node", "hub"), "stars")
    # what is known of the nodes that share a bucket
    known = nodes.where("own IS NOT NULL").select("node", "id", "n", "least", "own.*").hint("merge").join(stars.select("node").distinct(), "node", "left_semi")
    known = written(known, "known")
    bins = n_bands * rows
    pairs = stars.where("node <> hub").select(F.col("node").alias("doc"), "hub").distinct()
    pairs = pairs.hint("merge").join(known.select(F.col("node").alias("doc"), "n", "sketch"), "doc").hint("merge").join(known.select(F.col("node").alias("hub"), F.col("n").alias("n_hub"), F.col("sketch").alias("of_hub")), "hub")
    pairs = written(pairs.where(_alike("sketch", "of_hub", "n", "n_hub", bins, threshold)).select("doc", "hub"), "pairs")
    ends = pairs.select(F.col("doc").alias("node")).union(pairs.select(F.col("hub").alias("node"))).distinct()
    sets = sets_of(texts, known.hint("merge").join(ends, "node", "left_semi"), width)
    edges = written(confirmed(pairs, sets, threshold), "links")
    removed(sets, pairs)
    labels = components(edges)

    # buckets that hold several components: every node outside the bucket's largest one against all the others
    member = stars.hint("merge").join(known.select("node", "n", "sketch"), "node").hint("merge").join(labels.withColumnRenamed("node", "v"), F.col("node") == F.col("v"), "left")
    member = written(member.select("bucket", "node", "n", "sketch", F.coalesce("label", "node").alias("label")), "members")
    removed(stars)
    mixed = member.groupBy("bucket", "label").agg(F.count("*").alias("m")).groupBy("bucket")
    mixed = mixed.agg(F.sum("m").alias("m"), F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("k")).where("k > 1")
    rest = member.hint("merge").join(mixed.select("bucket", "main", F.ceil(F.col("m") / PART_ROWS).cast("int").alias("parts")), "bucket")
    rest = written(rest.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "rest")
    removed(member)
    heads = rest.where("label <> main").drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def near(m: str, h: str):
        same = (F.col(f"{m}.bucket") == F.col(f"{h}.bucket")) & (F.col(f"{m}.part") == F.col(f"{h}.part")) & (F.col(f"{m}.label") != F.col(f"{h}.label"))
        # two nodes that are both outside the largest component meet once
        same = same & ((F.col(f"{m}.label") == F.col(f"{m}.main")) | (F.col(f"{m}.node") > F.col(f"{h}.node")))
        return same & _alike(f"{m}.sketch", f"{h}.sketch", f"{m}.n", f"{h}.n", bins, threshold)

    # first who has anybody near at all; then full sets decide inside the join, so that only links come out of it
    live = written(rest.alias("m").hint("merge").join(heads.alias("h"), near("m", "h"), "left_semi"), "live")
    live_heads = written(heads.alias("h").hint("merge").join(rest.alias("m"), near("m", "h"), "left_semi"), "live_heads")
    removed(rest)
    if not live.isEmpty():
        ends = live.select("node").union(live_heads.select("node")).distinct()
        held = known.hint("merge").join(ends, "node", "left_semi")
        sets = sets_of(texts, held, width)
        sets = sets.hint("merge").join(held.select("node", "bands"), "node")
        m = live.hint("merge").join(sets, "node").alias("m")
        h = live_heads.hint("merge").join(sets, "node").alias("h")
        # a pair shares several buckets: its sets are compared in the one with the least key
        once = F.col("m.bucket") == F.array_min(F.array_intersect("m.bands", "h.bands"))
        links = m.hint("merge").join(h, near("m", "h") & once & _similar("m.elements", "h.elements", threshold))
        links = written(links.select(F.col("m.node").alias("doc"), F.col("h.node").alias("hub")).distinct(), "more_links")
        if not links.isEmpty():
            labels = components(edges.union(links))
    removed(live, live_heads)

    ids = labels.join(known.select("node", "least"), "node")
    ids = labels.join(ids.groupBy("label").agg(F.min("least").alias("cid")), "label").select(F.col("node").alias("v"), "label", "cid")
    out = nodes.select("id", "th", "n", "rep", "least").hint("merge").join(ids, F.col("rep") == F.col("v"), "left")
    component_id = F.coalesce("cid", "least")
    return out.select("id", "th", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"), F.coalesce("label", "rep").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` and ``kept`` of ``classes``, which says what each case gives."""
    return classes(docs, id_col, text_col, **how).drop("th", "component")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """``docs`` with one document of each component; the columns are those of ``docs``.

    The document with the least id stays; where that id has several texts of
    the component, the one with the least hash. Rows are told apart by id and
    text, so a text never goes because its id has another one that goes; rows
    that repeat both are one document and stay or go together.
    """
    key, th = fresh(docs.columns, "near_id", "near_th")
    found = written(classes(docs, id_col, text_col, **how).select("id", "th", "component", "kept"), "classes")
    twice = found.where("kept AND id IS NOT NULL").groupBy("component").agg(F.min("th").alias("first"), F.max("th").alias("last")).where("first <> last")
    later = found.where("kept AND id IS NOT NULL").join(twice, "component").where("th <> first")
    gone = found.where("NOT kept").select("id", "th").union(later.select("id", "th")).select(F.col("id").alias(key), F.col("th").alias(th)).distinct()
    return docs.join(gone, (F.col(id_col) == F.col(key)) & (F.xxhash64(F.col(text_col)) == F.col(th)), "left_anti")


def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """``near_duplicates`` over all documents with 4-word shingles, Jaccard 0.8."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=4).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
numbered AS (SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS df FROM sets),
both_ AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
  FROM numbered a JOIN numbered b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE a.df > 1 AND b.df > 1 GROUP BY ALL),
links AS (
  SELECT x, y FROM both_ JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * i >= 80 * (p.n + q.n - i)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(v, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.v, edges.y FROM reach JOIN edges ON edges.x = reach.r)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM documents d JOIN reach ON v = d.doc_id LEFT JOIN sizes USING (doc_id)
GROUP BY d.doc_id
"""
