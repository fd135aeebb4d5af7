"""An extension: conversion of files as they arrive, with the transforms of the batch planner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstream.plans.convert import convert

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """path and data of the files that come into a folder."""
    raw = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(path)
    return raw.select("path", F.col("content").alias("data"))


def convert_stream(spark: SparkSession, path: str, targets: list[str], sink: str, checkpoint: str, config: dict | None = None) -> StreamingQuery:
    """Append (result, output) of every file that comes to a Parquet folder, each exactly once."""
    got = convert(arriving(spark, path), targets, config=config)
    return got.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
