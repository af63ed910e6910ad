"""Recordings in folders: listing, importing what is new, headers, digests; the same as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import mime_of, parsed_filename

ENDINGS = "*.{m4a,wav,mp3,ogg,flac,aac,M4A,WAV,MP3,OGG,FLAC,AAC}"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Audio files of a folder (not of those in it): name, size, type, and what the name tells. Contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", ENDINGS).load(folder).select("path", "length", "modificationTime")
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("external_id"), F.col("length").alias("file_size_bytes"), mime_of(name).alias("mime_type"), parsed_filename(name).alias("parsed"))


def new_recordings(found: DataFrame, calls: DataFrame, first: int | None = None) -> DataFrame:
    """Recordings that no call has, in order of name, ``first`` of them if given."""
    rows = found.join(calls.select("external_id"), "external_id", "left_anti").orderBy("external_id")
    return rows.limit(first) if first else rows


def import_summary(found: DataFrame, new: DataFrame) -> DataFrame:
    """One row: files found, imported and skipped."""
    n = new.agg(F.count("*").alias("imported")).withColumn("k", F.lit(1))
    return found.agg(F.count("*").alias("found")).withColumn("k", F.lit(1)).join(n, "k").select("found", "imported", (F.col("found") - F.col("imported")).alias("skipped"))


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Size and SHA-256 of every file, computed where it is read."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", F.octet_length("content").cast("bigint").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def watched(spark: SparkSession, folder: str) -> DataFrame:
    """The folder as a stream: each file once, by the query's checkpoint."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", ENDINGS).load(folder)
    return files.select("path", F.substring_index("path", "/", -1).alias("external_id"), "length")


def safe_key(key: str) -> str:
    """A storage key without ways out of the folder."""
    parts = [p for p in key.replace("\\", "/").split("/") if p not in ("", ".", "..")]
    if not parts:
        raise ValueError("empty storage key")
    return "/".join(parts)
