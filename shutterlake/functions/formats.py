"""Hashes and formats of files by their bytes, as native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first bytes (hex) of image formats, each with the least length of a file, in the order in which they are tried.
MAGIC = [("FFD8FF", "jpeg", 4), ("89504E470D0A1A0A", "png", 8), ("474946383761", "gif", 6), ("474946383961", "gif", 6), ("424D", "bmp", 4), ("49492A00", "tiff", 4), ("4D4D002A", "tiff", 4)]
#: What brands behind "ftyp" mean.
BRANDS = {"avif": ["avif", "avis", "MA1A", "MA1B"], "heic": ["heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs"], "heif": ["mif1", "msf1"]}


def _hex(text: str) -> str:
    return text.encode().hex().upper()


def image_format(content: Column) -> Column:
    """The format that the first bytes tell: jpeg, png, gif, bmp, tiff, webp, svg, avif, heic or heif; null for others and under 4 bytes."""
    size, head = F.octet_length(content), F.hex(F.substring(content, 1, 12))
    cases = F.when(content.isNull() | (size < 4), F.lit(None).cast("string"))
    for start, name, least in MAGIC:
        cases = cases.when(head.startswith(start) & (size >= least), name)
    cases = cases.when(head.startswith(_hex("RIFF")) & (F.substring(head, 17, 8) == _hex("WEBP")), "webp")
    front = F.hex(F.substring(content, 1, 100))
    # at even places only, where a byte begins
    has = lambda t: F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(front) - 1), F.lit(2)), lambda i: front.substr(i, F.lit(2 * len(t))) == _hex(t))
    cases = cases.when((size >= 5) & front.contains(_hex("<svg")) & has("<svg"), "svg").when((size >= 5) & front.contains(_hex("<?xml")) & has("<?xml"), "svg")
    for name, brands in BRANDS.items():
        met = reduce(Column.__or__, (F.substring(head, 17, 8) == _hex(b) for b in brands))
        cases = cases.when((F.substring(head, 9, 8) == _hex("ftyp")) & met, name)
    return cases


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, as the library names files; null for null."""
    return F.sha2(content, 256)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, hash, format) of the files under ``path`` whose names match ``pattern``.

    A file is a row, read by the task that hashes it, so a file must fit a row (2 GB). Spark's source passes over empty files.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return read.select("path", F.col("length").alias("size"), content_hash(F.col("content")).alias("hash"), image_format(F.col("content")).alias("format"))


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, changed_at) of files, without reading them: the content column is pruned."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed_at"))
