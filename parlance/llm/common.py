"""What the corpus operators share: scratch tables, free names, Feistel networks.

Scratch tables live in the folder that ``spark.checkpoint.dir`` names, which a
cluster shares between the driver and all executors; a lost executor therefore
never takes a table with it. Tables that only a step needs are removed after
it; the rest go when the driver's JVM ends.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blank characters of the word and line contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: A word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Each application's scratch folder.
_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder.

    Where none is set, local mode (tests) gets a temporary folder; on a cluster
    that is an error, since every executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="parlance-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a scratch table or folder; the application's scratch goes when its JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{shared_dir(spark)}/parlance-{uuid.uuid4().hex}"
        place, files = _folder(spark, _ROOTS[app])
        files.mkdirs(place)
        files.deleteOnExit(place)
    return f"{_ROOTS[app]}/{uuid.uuid4().hex}-{name}"


#: With it, a query's shuffle files go at its end and don't wait for the driver's garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def saving(spark: SparkSession) -> Iterator[None]:
    """Around a write whose shuffles nothing reads again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a written table: cuts the lineage and lets several readers share it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with saving(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def removed(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for df in tables:
        place, files = _folder(df.sparkSession, df.scratch_path)
        files.delete(place, True)


def bounded_sample(df: DataFrame, rows: int, *by: Column) -> DataFrame:
    """At most ``rows`` rows of ``df``, those with the least hashes of ``by``.

    A cut on the hash leaves about twice as many, so that what is sorted and
    sent is bounded however many partitions there are.
    """
    n = max(df.count(), 1)
    h = F.pmod(F.xxhash64(*by), F.lit(2**40))
    return df.where(h <= F.lit(min(2**40, 2**41 * rows // n + 2**41 * 20 // n))).orderBy(h, *by).limit(rows)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names not among ``taken``, without regard to case: ``name``, else ``name_1`` and so on."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        free, k = name, 0
        while free.lower() in used:
            k += 1
            free = f"{name}_{k}"
        used.add(free.lower())
        out.append(free)
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is (``lower`` would change other letters too)."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def salted_groups(df: DataFrame, keys: list[str], spread: str, salt: str = "salt") -> DataFrame:
    """``df`` with a salt that depends on column ``spread`` alone.

    A group of ``keys`` falls into as many parts as there are shuffle
    partitions, so that no task gets more than its share of a hot group; rows
    that are equal in ``spread`` stay in one part.
    """
    return df.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(max(8, partitions(df.sparkSession)))).cast("int"))


def bit_table(marks: DataFrame, col: str, bits: int) -> np.ndarray:
    """A table of ``bits`` bits (a power of two of 32,768 at least) with the bits in ``marks[col]`` set, as bytes.

    The bits are put together in Spark, 4 KB for each 32,768 of them; what
    comes to the driver is bounded by ``bits``.
    """
    at = F.col(col).cast("bigint")
    maps = marks.groupBy(F.call_function("div", at, F.lit(32_768).cast("bigint")).alias("block")).agg(F.call_function("bitmap_construct_agg", at % 32_768).alias("map"))
    table = np.zeros(bits // 8, np.uint8)
    for row in maps.collect():
        table[row.block * 4096 : (row.block + 1) * 4096] = np.frombuffer(bytes(row.map), np.uint8)
    return table


#: The most bits of a filter that is sent to all tasks (128 MB).
MOST_BITS = 2**30


def filter_bits(items: int, most: int = MOST_BITS) -> int:
    """Bits for a filter of ``items``: 16 for each, 2 ** 20 at least, ``most`` at most (then it lets more through)."""
    return min(most, max(2**20, 1 << (16 * items).bit_length()))


def places(c: Column, bits: int) -> list[Column]:
    """A value's two bits in a filter."""
    return [F.xxhash64(c, F.lit(k)).bitwiseAND(F.lit(bits - 1)) for k in (1, 2)]


def feistel_sides(n: int) -> tuple[int, int]:
    """a and b with a * b >= n, as near to n and to one another as may be."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1) if n > 1 else 1
    return a, max(1, -(-n // a))


def _round(key: str, r: Column, half: Column) -> Column:
    """The keyed round function: 60 bits of a SHA-256."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), r.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel_pair(left: Column, right: Column, a: int | Column, b: int | Column, key: str, rounds: int = 8, inverse: bool = False) -> Column:
    """A keyed permutation of all pairs (l below a, r below b), as a struct (l, r).

    Even rounds add F(r) to l, odd rounds add F(l) to r. ``aggregate`` keeps the
    expression linear in the number of rounds.
    """
    a, b = (F.lit(v).cast("bigint") if isinstance(v, int) else v for v in (a, b))
    sign = -1 if inverse else 1
    steps = F.array(*[F.lit(i) for i in (reversed(range(rounds)) if inverse else range(rounds))])
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        even = F.struct(F.pmod(acc["l"] + sign * (_round(key, i, acc["r"]) % a), a).cast("bigint").alias("l"), acc["r"].alias("r"))
        odd = F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + sign * (_round(key, i, acc["l"]) % b), b).cast("bigint").alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(steps, start, step)


def feistel(x: Column, a: int | Column, b: int | Column, key: str, rounds: int = 8, inverse: bool = False) -> Column:
    """A keyed permutation of 0 to a * b - 1 as one expression: of the pairs that x makes."""
    a, b = (F.lit(v).cast("bigint") if isinstance(v, int) else v for v in (a, b))
    pair = feistel_pair(F.call_function("div", x.cast("bigint"), b), F.pmod(x, b), a, b, key, rounds, inverse)
    return F.transform(F.array(pair), lambda p: p["l"] * b + p["r"])[0]


#: Steps of a cycle walk that an expression may take. Every step leaves the range with a chance under 1/sqrt(n).
WALK = 24


def permuted(x: Column, n: int, key: str, rounds: int = 8, inverse: bool = False) -> Column:
    """A keyed permutation of 0 to n - 1: a Feistel network over a * b >= n values, walked until below n.

    A walk beyond WALK steps (chance under n ** -12; none at all for n below
    500) is an error and never a wrong slot.
    """
    a, b = feistel_sides(n)
    once = feistel(x, a, b, key, rounds, inverse)
    if a * b == n:
        return once
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        once,
        lambda acc, _: F.when(acc < n, acc).otherwise(feistel(acc, a, b, key, rounds, inverse)),
    )
    return F.transform(F.array(walked), lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint")))[0]


def feistel_plain(x: int, a: int, b: int, key: str, rounds: int = 8, inverse: bool = False) -> int:
    """``feistel`` for one integer in plain Python (tests and readers without Spark)."""
    import hashlib

    left, right = divmod(x, b)
    for i in reversed(range(rounds)) if inverse else range(rounds):
        half = right if i % 2 == 0 else left
        f = int(hashlib.sha256(f"{key}:{i}:{half}".encode()).hexdigest()[:15], 16) * (-1 if inverse else 1)
        if i % 2 == 0:
            left = (left + f) % a
        else:
            right = (right + f) % b
    return left * b + right


def permuted_plain(x: int, n: int, key: str, rounds: int = 8, inverse: bool = False) -> int:
    """``permuted`` for one integer in plain Python."""
    a, b = feistel_sides(n)
    x = feistel_plain(x, a, b, key, rounds, inverse)
    while x >= n:
        x = feistel_plain(x, a, b, key, rounds, inverse)
    return x
