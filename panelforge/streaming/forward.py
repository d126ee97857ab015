"""A forward run that never looks back: an event log appended once per event, from batches or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelforge.operators.tables import append_unique


def tick(log: DataFrame, arrived: DataFrame, through: str) -> DataFrame:
    """Events up to ``through`` are appended if their ``event_id`` is new; a repeated tick adds nothing, two payloads of one id fail."""
    return append_unique(log, arrived.filter(F.col("trade_date") <= through), "event_id", "payload")


def event_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and their value per window and type; on a stream, rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total")


def append_stream(events: DataFrame, path: str, checkpoint: str):
    """Write a stream of events once each; the caller stops the query."""
    once = events.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
