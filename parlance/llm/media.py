"""Media columns: content-defined chunks, a deduplicated chunk store, verified reading back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BITS, bit_table, filter_bits, removed, saving, scratch, written
from .minhash import mix

#: Payloads are filled up with zero bytes to a multiple of this many units.
UNIT = 64


@dataclass(frozen=True)
class Cuts:
    """Chunk sizes in bytes (``mean`` beyond ``least`` is a power of two), and the most bits of the filter.

    The filter tells which chunks may be held twice. It is sent to every task,
    so its size is bounded: 16 bits for each such chunk, 2 ** 20 at least,
    ``most_bits`` at most (128 MB). A fuller filter only sends more chunks
    through the shared store; it never changes a payload.

    A chunk that more than ``hot`` documents may refer to is joined in parts of
    that size. Of ``references`` references in all, at most references / ``hot``
    chunks are hot, and their list is sent to all tasks only up to ``most_hot``
    of them; more are joined without parts.
    """

    least: int = 512
    mean: int = 2048
    most: int = 8192
    most_bits: int = MOST_BITS
    hot: int = 100_000
    most_hot: int = 250_000


_GEAR = (mix(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def cut(payload: bytes, cuts: Cuts = Cuts()) -> list[int]:
    """The chunks' lengths. A cut follows a byte where the gear hash of the last 32 bytes has its top bits zero."""
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    for s in (1, 2, 4, 8, 16):  # h[i] = sum of gear[b[i - k]] << k for k below 32, by doubling
        t = h.copy()
        t[s:] += h[:-s] << np.uint32(s)
        h = t
    places = np.flatnonzero(h >> np.uint32(32 - (cuts.mean.bit_length() - 1)) == 0) + 1
    out, at, n = [], 0, len(payload)
    for p in [*places.tolist(), n]:
        while p - at > cuts.most:
            out.append(cuts.most)
            at += cuts.most
        if p - at >= cuts.least or (p == n and p > at):
            out.append(p - at)
            at = p
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 with zero bytes up to a positive multiple of UNIT, and its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"), len(raw)


def _chunks(payload: bytes, lens: list[int]) -> list[bytes]:
    ends = np.cumsum(lens).tolist()
    return [payload[e - n : e] for e, n in zip(ends, lens, strict=True)]


def manifest(n_bytes: int, lens: list[int], digests: list[bytes]) -> bytes:
    """The ordered chunk list as bytes: length of the text, number of chunks, then each one's length and SHA-256."""
    return b"".join([struct.pack("<QI", n_bytes, len(lens)), *[struct.pack("<I", n) + d for n, d in zip(lens, digests, strict=True)]])


def listed(stored: bytes) -> tuple[int, list[int], list[bytes]]:
    """``manifest`` read back."""
    n_bytes, n = struct.unpack_from("<QI", stored)
    return n_bytes, [struct.unpack_from("<I", stored, 12 + 36 * i)[0] for i in range(n)], [stored[16 + 36 * i : 48 + 36 * i] for i in range(n)]


def _digests(cuts: Cuts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0):
                payload, _ = payload_of(text.as_py())
                out += [hashlib.sha256(c).digest() for c in _chunks(payload, cut(payload, cuts))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["digest"])

    return run


def _bits(digest: bytes, bits: int) -> tuple[int, int]:
    """The filter's two bits of a digest; ``bits`` is a power of two."""
    return int.from_bytes(digest[:7]) & bits - 1, int.from_bytes(digest[8:15]) & bits - 1


def _stored(cuts: Cuts, filled: Broadcast, bits: int):
    """A container row for each document, and a row for each chunk that may be held twice (once in a task's block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, part, number = zstandard.ZstdCompressor(level=6), TaskContext.get().partitionId() << 40, 0
        twice = filled.value
        # the chunks that this task has sent already; forgotten when many
        sent: set[bytes] = set()
        for batch in batches:
            kind, cid, doc, listing, shared, packed = [], [], [], [], [], []
            size = 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(cid, pa.int64()), pa.array(doc, batch.schema.field(0).type), pa.array(listing, pa.binary()), pa.array(shared, pa.list_(pa.int32())), pa.array(packed, pa.binary())], ["kind", "cid", "id", "manifest", "shared", "packed"])

            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                payload, n = payload_of(text.as_py())
                lens = cut(payload, cuts)
                chunks = _chunks(payload, lens)
                digests = [hashlib.sha256(c).digest() for c in chunks]
                apart = []
                for k, d in enumerate(digests):
                    a, b = _bits(d, bits)
                    if twice[a >> 3] >> (a & 7) & 1 and twice[b >> 3] >> (b & 7) & 1:
                        apart.append(k)
                        if d not in sent:
                            if len(sent) > 200_000:
                                sent.clear()
                            sent.add(d)
                            for column, x in zip((kind, cid, doc, listing, shared, packed), (1, None, None, d, None, press.compress(chunks[k])), strict=True):
                                column.append(x)
                away = set(apart)
                own = press.compress(b"".join(c for k, c in enumerate(chunks) if k not in away))
                for column, x in zip((kind, cid, doc, listing, shared, packed), (0, part + number, i, manifest(n, lens, digests), apart, own), strict=True):
                    column.append(x)
                number += 1
                size += len(payload)
                if size > 8_000_000:
                    yield made()
                    kind, cid, doc, listing, shared, packed = [], [], [], [], [], []
                    size = 0
            yield made()

    return run


def features(payload: bytes) -> str:
    """What the samples look like: mean, deviation, entropy in bits, and share of sign changes around 128."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    flips = np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)) / len(x)
    return f"mean={x.mean():.6f};std={x.std():.6f};entropy={-(p * np.log2(p)).sum():.6f};flips={flips:.6f}"


READ = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_chunks int, n_shared int"


def read_back(stored: bytes, apart: list[int], packed: bytes, others: dict[int, bytes], press: zstandard.ZstdDecompressor) -> tuple[bytes, int, list[int]]:
    """The payload of a container; every chunk's digest must be the one listed."""
    n_bytes, lens, digests = listed(stored)
    own, at, out, away = press.decompress(packed), 0, [], set(apart)
    for k, n in enumerate(lens):
        if k in away:
            chunk = press.decompress(others[k])
        else:
            chunk = own[at : at + n]
            at += n
        if len(chunk) != n or hashlib.sha256(chunk).digest() != digests[k]:
            raise ValueError("a stored chunk differs from its digest")
        out.append(chunk)
    return b"".join(out), n_bytes, lens


def stored_form(manifest: bytes, shared: list[int], packed: bytes, others: dict[int, bytes]) -> list[bytes]:
    """The bytes that lie in storage for one document, in order: its container's, then those of the store's chunks that it refers to."""
    return [manifest, struct.pack(f"<{len(shared)}I", *shared), packed, *[others[k] for k in shared]]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for listing, apart, packed, got in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
            others = {x["pos"]: x["bytes"] for x in got.as_py() or []}
            payload, n, lens = read_back(listing, apart, packed, others, press)
            form, media = stored_form(listing, apart, packed, others), hashlib.sha256()
            for part in form:
                media.update(part)
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), sum(map(len, form)), media.hexdigest(), features(payload), len(lens), len(apart)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["id", *[x.split()[0] for x in READ.split(", ")]])


def stored_media(docs: DataFrame, cuts: Cuts = Cuts(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stores every row's payload: (containers, store).

    1. All payloads are cut; digests that occur twice or more set bits in a
       filter of bounded size (built in Spark, 4 KB for a row).
    2. Each document's container holds its manifest (the ordered list of its
       chunks) and, compressed, the chunks that only it holds. Chunks that the
       filter names go to the store.
    3. The store keeps one row for each digest, with the number of chunks that
       have it.

    A null or empty text is 64 zero bytes. Equal texts have equal payloads,
    containers and features. Repeated rows each have a container; a very long
    text is one container, worked on in memory; an empty table has none; columns
    but id and text play no part.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    digests = texts.select("text").mapInArrow(_digests(cuts), "digest binary")
    twice = written(digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    bits = filter_bits(twice.count(), cuts.most_bits)
    places = [F.conv(F.substring(F.hex("digest"), at, 14), 16, 10).cast("bigint").bitwiseAND(F.lit(bits - 1)) for at in (1, 17)]
    marks = twice.select(F.explode(F.array(*places)).alias("bit"))
    table = bit_table(marks, "bit", bits)
    schema = f"kind int, cid bigint, id {texts.schema['id'].dataType.simpleString()}, manifest binary, shared array<int>, packed binary"
    folder = scratch(spark, "media")
    with saving(spark):
        texts.mapInArrow(_stored(cuts, spark.sparkContext.broadcast(table), bits), schema).write.partitionBy("kind").option("compression", "uncompressed").parquet(folder)
    both = spark.read.schema(schema).parquet(folder)
    containers = both.where("kind = 0").select("cid", "id", "manifest", "shared", "packed")
    packed = both.where("kind = 1").groupBy(F.col("manifest").alias("digest")).agg(F.first("packed").alias("packed"))
    store = written(packed.join(twice, "digest", "left").select("digest", "packed", F.coalesce("n", F.lit(1)).alias("n")), "store", compression="uncompressed")
    removed(twice)
    return containers, store


def read_media(containers: DataFrame, store: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """``id`` and the fields of READ for each container, from the stored bytes alone.

    References are joined to the store by digest, hot ones by digest and part,
    and come back to their container in order; a container without any is read
    where it lies.
    """
    apart = containers.where(F.size("shared") > 0)
    refs = apart.select("cid", "manifest", F.explode("shared").alias("pos"))
    refs = refs.select("cid", "pos", F.expr("substring(manifest, 17 + 36 * pos, 32)").alias("digest"))
    parts = F.ceil(F.col("n") / cuts.hot).cast("int")
    hot = store.where(F.col("n") > cuts.hot).select("digest", parts.alias("parts"))
    if 0 < hot.count() <= cuts.most_hot:
        refs = refs.join(F.broadcast(hot), "digest", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("cid", "pos"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        held = store.select("digest", "packed", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    else:
        refs, held = refs.withColumn("part", F.lit(0)), store.select("digest", "packed", F.lit(0).alias("part"))
    got = refs.join(held, ["digest", "part"]).groupBy("cid").agg(F.collect_list(F.struct("pos", F.col("packed").alias("bytes"))).alias("others"))
    apart = apart.join(got, "cid").select("id", "manifest", "shared", "packed", "others")
    alone = containers.where(F.size("shared") == 0).select("id", "manifest", "shared", "packed", F.lit(None).cast(got.schema["others"].dataType).alias("others"))
    schema = f"id {containers.schema['id'].dataType.simpleString()}, {READ}"
    return alone.mapInArrow(_read, schema).unionByName(apart.mapInArrow(_read, schema))


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    """Stores all documents' payloads as chunks and reads them back.

    ``media_bytes`` and ``media_sha256`` are of ``stored_form``: the container
    as it lies in storage, and the shared chunks that it refers to.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_media(*stored_media(docs)).withColumnRenamed("id", "doc_id")
