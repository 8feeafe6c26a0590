"""File sources: folder scan with extension filter, content hash of file bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions.text import content_hash, file_extension


def scan_files(
    spark: SparkSession, folder: str, extensions: Sequence[str] = tuple(fixed.SUPPORTED_EXTENSIONS)
) -> DataFrame:
    """Files directly in the folder whose suffix is accepted, one row each.

    The content column is read only by a plan that uses it.
    """
    files = spark.read.format("binaryFile").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    return files.select("path", name.alias("filename"), file_extension(F.col("path")).alias("extension"),
                        "length", "modificationTime", "content").where(F.col("extension").isin(list(extensions)))


def hash_files(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Adds the digest of the whole content of every file."""
    return files.withColumn("file_hash", content_hash(F.col("content"), algorithm))
