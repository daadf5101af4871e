"""Event-time windows over a table or stream with a timestamp ``ts``.

These are extensions: the same function serves a batch and a stream, where the
watermark bounds the state and drops what comes too late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prepared(df: DataFrame, delay: str = "1 day") -> DataFrame:
    """``ts`` as a timestamp, with a watermark where the input is a stream."""
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", delay) if df.isStreaming else df


def _counted(df: DataFrame, window, by: list[str], value: str) -> DataFrame:
    out = df.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def tumbling(df: DataFrame, size: str, by: list[str], value: str) -> DataFrame:
    return _counted(prepared(df), F.window("ts", size), by, value)


def sliding(df: DataFrame, size: str, step: str, by: list[str], value: str) -> DataFrame:
    return _counted(prepared(df), F.window("ts", size, step), by, value)


def sessions(df: DataFrame, gap: str, by: list[str], value: str) -> DataFrame:
    return _counted(prepared(df), F.session_window("ts", gap), by, value)


def deduplicated(df: DataFrame, key: list[str]) -> DataFrame:
    """One event per key; in a stream, within the watermark."""
    df = prepared(df)
    return df.dropDuplicatesWithinWatermark(key) if df.isStreaming else df.dropDuplicates(key)


def late(df: DataFrame, order: str, delay: str, newest: str | None = None, oldest: str | None = None) -> DataFrame:
    """Events that come, in arrival order, after an event more than ``delay`` ahead of them.

    Of events that arrive together, those with the greatest ``newest`` or the least ``oldest`` come
    first; without either their order, and with it the result, is open.
    The running maximum goes over runs of 100,000 arrivals first, so no task sees all events.
    """
    from pyspark.sql import Window

    df = df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_part", F.floor(F.col(order) / 100_000))
    tops = df.groupBy("_part").agg(F.max("ts").alias("_top"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_part", F.max("_top").over(before).alias("_before"))
    ties = [*([F.col(newest).desc()] if newest else []), *([F.col(oldest)] if oldest else [])]
    inside = Window.partitionBy("_part").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max("ts").over(inside), F.col("_before"))
    return df.join(tops, "_part").withColumn("_seen", seen).filter(F.col("ts") < F.col("_seen") - F.expr(f"INTERVAL {delay}")).drop("_part", "_before", "_seen")
