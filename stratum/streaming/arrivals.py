"""Snapshots of folders as they arrive, by Structured Streaming's file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_files(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (path, modified, size) of archives or region files that appear below root."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def ingest_each(stream: DataFrame, checkpoint: str, take) -> object:
    """Calls take(DataFrame, batch id) once for each micro-batch of what has arrived; take must be idempotent."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
