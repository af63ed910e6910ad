"""Files that appear whole or not at all, in any file system that Spark can write to."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

from parlance.sources.files import safe_key


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of a folder's published files, in order; none if there is no folder."""
    place, files = _at(spark, folder)
    if not files.exists(place):
        return []
    return sorted(n for n in (s.getPath().getName() for s in files.listStatus(place)) if not n.startswith((".", "_")))


def read(spark: SparkSession, path: str) -> str:
    place, files = _at(spark, path)
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class Taken(FileExistsError):
    """There is a file of that name already."""


def put(spark: SparkSession, folder: str, key: str, chunks: Iterable[bytes], replace: bool = False) -> tuple[int, str]:
    """Stores a file under ``key`` and returns its size and SHA-256, taken while it is written.

    The chunks go to a hidden file beside the place, which is then renamed: a
    reader sees the whole file or none, and a writer that dies leaves a hidden
    file at most. A key can't lead out of the folder. A file that is there
    already is an error, or with ``replace`` gives way.
    """
    jvm, key = spark._jvm, safe_key(key)
    target, files = _at(spark, f"{folder}/{key}")
    staged = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    files.mkdirs(target.getParent())
    digest, size = hashlib.sha256(), 0
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(option, 1 if replace else 0)
    if replace:
        how[0] = option.OVERWRITE
    try:
        stream = files.create(staged, False)
        try:
            for chunk in chunks:
                stream.write(bytearray(chunk))
                digest.update(chunk)
                size += len(chunk)
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(staged, target, how)
    except Exception as e:
        files.delete(staged, False)
        if "FileAlreadyExists" in str(e):
            raise Taken(key) from e
        raise
    return size, digest.hexdigest()


def publish(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Stores a small text file; false if another writer was first."""
    try:
        put(spark, folder, name, [text.encode()])
        return True
    except Taken:
        return False


def removed(spark: SparkSession, path: str) -> None:
    place, files = _at(spark, path)
    files.delete(place, True)
