"""Metafiles as they arrive: a folder as a stream, framed and decoded file by file without state between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strokelake.functions import layouts
from strokelake.sources import metafiles


def stream_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """``path, content`` of new files, at most ``files_per_batch`` a micro-batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "content")


def stream_records(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Decoded records of new files."""
    return layouts.decode(metafiles.records(stream_files(spark, folder, files_per_batch)))


def stream_issues(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Faults of new files."""
    return metafiles.issues(stream_files(spark, folder, files_per_batch))
