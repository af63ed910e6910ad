"""Token-ID output in training order: packed sequences, a keyed permutation, fixed-stride shards."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, partitions, permuted, removed, saving, scratch, written
from .sharding import running

#: Distinct words whose ids a Python worker keeps.
WORDS_KEPT = 400_000
#: The byte after each record: Spark's text writer, which writes the shards, ends a line with it.
RECORD_END = b"\n"


@dataclass(frozen=True)
class Layout:
    """Ids in a sequence, sequences in a shard, the permutation's key, and the vocabulary.

    An id is two bytes, low byte first; a document ends with ``end``; the last
    sequence of a bucket is filled up with ``end``. ``model`` is a tiktoken
    ranks file whose ids and ``end`` are below 65,536. A bucket holds about
    ``bucket_rows`` documents, more only where there would be over
    ``most_buckets``: a row for each bucket is sent to all tasks.
    """

    length: int = 1024
    per_shard: int = 2048
    key: str = "order-1"
    end: int = 50_256
    model: str | None = None
    bucket_rows: int = 512
    most_buckets: int = 1_000_000

    @property
    def stride(self) -> int:
        return 2 * self.length + len(RECORD_END)


def default_model() -> str:
    """The installed public vocabulary's place."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


class Encoder:
    """Text to ids as bytes. Words after one space are encoded apart and kept."""

    def __init__(self, model: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(model, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.array([len(w) for w, _ in sorted(ranks.items(), key=lambda x: x[1])], np.int64)
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.enc.encode_ordinary(text), "<u2").tobytes()

    def learn(self, words: set[str]) -> None:
        """The ids of `` word`` for each of ``words``, all in one call: they are told apart by their pieces' bytes."""
        new = list(words)
        ids = np.array(self.enc.encode_ordinary(" " + " ".join(new)), "<u2")
        ends = np.cumsum([1 + len(w.encode()) for w in new])
        cut, raw = (2 * (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1)).tolist(), ids.tobytes()
        self.known.update(zip(new, map(raw.__getitem__, map(slice, [0, *cut[:-1]], cut)), strict=True))

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, just as for the whole text at once.

        The vocabulary's pattern takes a single space together with the word
        after it, so a text splits before such a space without any change; a
        text with two spaces in a row, or long words, is encoded whole.
        """
        known = self.known
        if len(known) >= WORDS_KEPT:
            known.clear()
        parts = [t.split(" ") for t in texts]
        words = set().union(*parts).difference(known)
        self.learn({w for w in words if w and len(w) <= 64})
        known[""] = b""
        out = []
        for text, p in zip(texts, parts, strict=True):
            try:
                if "  " in text or text.endswith(" "):
                    raise KeyError
                out.append(b"".join([self.whole(p[0]) if p[0] else b"", *map(known.__getitem__, p[1:])]))
            except KeyError:
                out.append(self.whole(text))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.enc.decode(ids)


@lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    return Encoder(model)


#: Documents that the sequences' compression is fitted to, and the dictionary's bytes. Both bound what is sent.
SAMPLE, DICTIONARY = 1500, 112_640


def _dictionary(texts: DataFrame, layout: Layout, model: str) -> bytes:
    """A compression dictionary for sequences from a bounded sample of documents; empty if there are too few.

    It saves scratch space only: any dictionary gives the same shards.
    """
    sample = bounded_sample(texts.select(F.substring("text", 1, 20_000).alias("text")), SAMPLE, F.col("text"))
    encode, size = encoder(model), 2 * layout.length
    run = b"".join(encode.many([r.text or "" for r in sample.collect()]))
    cut = [run[i : i + size] for i in range(0, len(run) - size + 1, size)]
    try:
        return zstandard.train_dictionary(DICTIONARY, cut).as_bytes() if len(run) >= 8 * DICTIONARY else b""
    except zstandard.ZstdError:
        return b""


#: The sequences' compression level in the scratch table and the shuffle.
LEVEL = 6
#: Characters of text that are encoded at once.
BLOCK = 2_000_000


def _fitted(fitted: bytes) -> dict:
    if not fitted:
        return {}
    found = zstandard.ZstdCompressionDict(fitted)
    found.precompute_compress(level=LEVEL)
    return {"dict_data": found}


def _packed(layout: Layout, model: str, fitted: bytes):
    """Documents in order of their buckets to sequences: a bucket's ids and end marks in a row, cut every ``length`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = encoder(model), 2 * layout.length
        end, press = np.array([layout.end], "<u2").tobytes(), zstandard.ZstdCompressor(level=LEVEL, **_fitted(fitted))
        now, number, rest = None, 0, b""
        out: tuple[list, list, list] = ([], [], [])

        def cut(run_of: bytes) -> None:
            nonlocal number
            for i in range(0, len(run_of), size):
                for column, x in zip(out, (now, number, press.compress(run_of[i : i + size])), strict=True):
                    column.append(x)
                number += 1

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["bucket", "number", "packed"])
            for column in out:
                column.clear()
            return batch

        def filled(run_of: bytes) -> bytes:
            return run_of + end * (-len(run_of) % size // 2)

        for batch in batches:
            buckets, at = batch.column(0).to_pylist(), 0
            while at < len(buckets):
                texts, have = [], 0
                while at + len(texts) < len(buckets) and have < BLOCK:
                    texts.append(batch.column(1)[at + len(texts)].as_py() or "")
                    have += len(texts[-1])
                for bucket, ids in zip(buckets[at : at + len(texts)], encode.many(texts), strict=True):
                    if bucket != now:
                        cut(filled(rest))
                        now, number, rest = bucket, 0, b""
                    rest += ids + end
                    whole = len(rest) - len(rest) % size
                    cut(rest[:whole])
                    rest = rest[whole:]
                at += len(texts)
                yield made()
        cut(filled(rest))
        yield made()

    return run


def _unpacked(fitted: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(**_fitted(fitted))
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([press.decompress(x.as_py()) for x in part.column(1)], pa.binary())], ["shard", "record"])

    return run


def materialised(docs: DataFrame, out: str | None = None, layout: Layout = Layout(), id_col: str = "doc_id", text_col: str = "text") -> tuple[str, int]:
    """Writes all of ``docs`` as shards in training order; gives the folder and the number of sequences.

    1. A document's bucket is a hash of its id and text, modulo a number that
       depends on the number of documents alone. Buckets are sorted by id and
       text hash, encoded, and cut into sequences, which are written once as a
       compressed table. So sequences, and with the key their order, follow from
       the documents, however these are dealt out over files and tasks.
    2. Sequences are numbered in the order of (bucket, number): the buckets'
       counts, one row for each, are summed up in parts.
    3. Sequence i goes to slot ``permuted(i)``: shard slot // per_shard, record
       slot % per_shard. Shards are range partitions, sorted by slot.
    4. Spark's text writer commits one file in the folder shard=K for each
       shard; a lost task is run again and leaves no part of a file behind.

    A null or empty text is one end mark; a null id sorts first. Rows that
    repeat id and text share a bucket and follow one another. A very long text
    is encoded in memory and fills as many sequences as it needs. An empty
    table gives no shards. Columns but id and text play no part.
    """
    spark, model = docs.sparkSession, layout.model or default_model()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fitted = _dictionary(texts, layout, model)
    rows = docs.count()
    buckets = max(1, -(-rows // max(layout.bucket_rows, -(-rows // layout.most_buckets))))
    dealt = texts.select(F.pmod(F.xxhash64("id", "text"), F.lit(buckets).cast("bigint")).alias("bucket"), "text", "id", F.xxhash64("text").alias("th"))
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "id", "th").select("bucket", "text")
    made = written(dealt.mapInArrow(_packed(layout, model, fitted), "bucket bigint, number bigint, packed binary"), "sequences", compression="uncompressed")
    sizes = made.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("cell", F.call_function("div", F.col("bucket"), F.lit(1024).cast("bigint")))
    sizes = written(running(sizes, [], "cell", [F.col("bucket")], F.col("n")).select("bucket", "n", F.col("before").alias("ahead")), "sizes")
    n = int(sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n)
    out = out or scratch(spark, "shards")
    if not n:
        return out, 0
    slot = permuted(F.col("ahead") + F.col("number"), n, layout.key)
    # at most most_buckets rows
    placed = made.join(F.broadcast(sizes.select("bucket", "ahead")), "bucket").select(slot.alias("slot"), "packed")
    placed = placed.withColumn("shard", F.call_function("div", F.col("slot"), F.lit(layout.per_shard).cast("bigint")).cast("int"))
    shards = -(-n // layout.per_shard)
    placed = placed.repartitionByRange(min(shards, 4 * partitions(spark)), "shard").sortWithinPartitions("shard", "slot").select("shard", "packed")
    records = placed.mapInArrow(_unpacked(fitted), "shard int, record binary")
    with saving(spark):
        records.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").text(out)
    removed(made, sizes)
    return out, n


def records(spark: SparkSession, folder: str, n: int, layout: Layout = Layout(), start: int = 0) -> DataFrame:
    """``slot``, ``sequence`` and ``record`` (the ids' bytes) from slot ``start`` on.

    The stride is fixed, so record r of a shard begins at r * stride and a
    reader goes on where it stopped; shards before that of ``start`` are not
    opened. A shard with a wrong size is an error.
    """
    if start >= n:
        return spark.createDataFrame([], "slot bigint, sequence bigint, record binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    per, stride = layout.per_shard, layout.stride
    files = files.where(F.col("shard") >= start // per)
    held = F.least(F.lit(per).cast("bigint"), F.lit(n) - F.col("shard").cast("bigint") * per)
    whole = F.when(F.col("length") == held * stride, held).otherwise(F.raise_error(F.lit("a shard has a wrong size")).cast("bigint"))
    rows = files.select("shard", "content", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("r"))
    rows = rows.select((F.col("shard").cast("bigint") * per + F.col("r")).alias("slot"), F.substring("content", (F.col("r") * stride + 1).cast("int"), F.lit(stride - 1)).alias("record"))
    return rows.where(F.col("slot") >= start).select("slot", permuted(F.col("slot"), n, layout.key, inverse=True).alias("sequence"), "record")


def op9_training_order(spark, sf_dir: str) -> DataFrame:
    """Writes all documents' shards, reads them back, and gives a row for each slot."""
    layout = Layout()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder, n = materialised(docs, layout=layout)
    if not n:
        return spark.createDataFrame([], "slot bigint, sequence bigint, shard int, offset bigint, n_ids int, ids_crc32 bigint, ids_sha256 string")
    per = layout.per_shard
    return records(spark, folder, n, layout).select(
        "slot", "sequence", F.call_function("div", F.col("slot"), F.lit(per).cast("bigint")).cast("int").alias("shard"),
        (F.pmod(F.col("slot"), F.lit(per)) * layout.stride).cast("bigint").alias("offset"),
        F.lit(layout.length).alias("n_ids"), F.crc32("record").alias("ids_crc32"), F.sha2("record", 256).alias("ids_sha256"),
    )
