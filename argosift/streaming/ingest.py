"""Resumable ingest and windowed counts as streams over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosift.sources.files import write_once


def ingest_once(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, keys: list[str], files_per_batch: int = 100):
    """Take in new Parquet files under ``source``; a key is written once, by the first batch that has it. Returns when all is taken in.

    A batch that is run again after a failure writes nothing twice, since its keys are there already.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def take(batch: DataFrame, _: int) -> None:
        write_once(batch, sink, keys)

    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, at: str, window: str, lateness: str, *by: str) -> DataFrame:
    """``(start, *by, n)`` by tumbling windows of event time; works on streams and tables. Rows later than ``lateness`` are dropped on streams."""
    rows = events.withWatermark(at, lateness) if events.isStreaming else events
    return rows.groupBy(F.window(at, window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def session_counts(events: DataFrame, at: str, gap: str, lateness: str, *by: str) -> DataFrame:
    """``(start, end, *by, n)`` by session windows that end after a gap."""
    rows = events.withWatermark(at, lateness) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
