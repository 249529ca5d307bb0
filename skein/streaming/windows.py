"""Event-time windows; the same functions serve streams and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _timed(events: DataFrame, at: str, late: str | None) -> DataFrame:
    typed = events.withColumn(at, F.col(at).cast("timestamp"))
    return typed.withWatermark(at, late) if late and events.isStreaming else typed


def _measures(value: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n_events"), F.round(F.sum(F.coalesce(F.col(value), F.lit(0.0))), 2).alias("total")]


def tumbling(events: DataFrame, at: str, width: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    """Counts and sums per window; events later than ``late`` are dropped by a stream."""
    grouped = _timed(events, at, late).groupBy(F.window(at, width).alias("w"), *by).agg(*_measures(value))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *by, "n_events", "total")


def sliding(events: DataFrame, at: str, width: str, step: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    grouped = _timed(events, at, late).groupBy(F.window(at, width, step).alias("w"), *by).agg(*_measures(value))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *by, "n_events", "total")


def sessions(events: DataFrame, at: str, gap: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    grouped = _timed(events, at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(*_measures(value))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("session_start"), *by, "n_events", "total")


def late_events(events: DataFrame, at: str, order: str, late_seconds: int) -> DataFrame:
    """Batch view of what a watermark would drop: events behind the greatest time before them.

    The running maximum is taken within days first and carried across days, so
    no task sorts the whole table.
    """
    day = F.floor(F.col(order) / 100_000)
    marked = events.withColumn("__b", day)
    tops = marked.groupBy("__b").agg(F.max(at).alias("__top"))
    carried = tops.select("__b", F.max("__top").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    inner = F.max(at).over(Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    seen = marked.withColumn("__inner", inner).join(carried, "__b", "left").withColumn("__seen", F.greatest("__inner", "__carry"))
    behind = F.col("__seen").cast("timestamp").cast("double") - F.col(at).cast("timestamp").cast("double") > late_seconds
    return seen.where(behind).drop("__b", "__inner", "__carry", "__seen")
