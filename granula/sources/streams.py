"""Streams of bytes from files, and stored frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_streams(spark: SparkSession, path: str, glob: str = "*.mp3") -> DataFrame:
    """stream_id (a hash of the path), path, content of every file: the binaryFile source, one row a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("stream_id"), "path", "content")


def write_frames(frames: DataFrame, path: str) -> None:
    """A frames table sorted inside its files by stream and frame: header-only queries prune the payload column, seeks prune row groups."""
    frames.repartition("stream_id").sortWithinPartitions("stream_id", "frame_no").write.mode("overwrite").parquet(path)
