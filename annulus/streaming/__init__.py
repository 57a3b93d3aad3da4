"""Exactly-once ingestion of an operation log and windowed counts, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_operations(log: DataFrame, key: str) -> DataFrame:
    """Latest row per key of a streaming or static log (op_id, ...); run in update or complete mode."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), "op_id").alias("r")).select(key, "r.*")


def windowed_counts(events: DataFrame, time: str, size: str, late: str, by: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))
