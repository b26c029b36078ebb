"""Streams over a folder that archives land in: detection and listing keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import native
from moraine.sources.parse import list_entries
from moraine.sources.wrappers import open_archives

BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_archives(spark: SparkSession, path: str, glob: str = "*", max_files: int = 1000) -> DataFrame:
    """(archive_id, name, content) of files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(path)
    return files.select(F.col("path").alias("archive_id"), native.basename(F.col("path")).alias("name"), "content")


def stream_entries(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Members of arriving archives, in append mode."""
    return list_entries(open_archives(stream_archives(spark, path, glob)))
