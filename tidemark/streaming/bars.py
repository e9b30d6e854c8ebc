"""Bars and input checks on event streams. All functions take a streaming or a static frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, order: str = "ts") -> DataFrame:
    """The time column as TIMESTAMP, which watermarks need."""
    return df.withColumn(order, F.col(order).cast("timestamp"))


def stream_bars(
    events: DataFrame, every: str = "1 hour", slide: str | None = None, session_gap: str | None = None, watermark: str = "1 hour", key: Sequence[str] = ("event_type",),
    value: str = "value", order: str = "ts",
) -> DataFrame:
    """Bars per key over tumbling windows, sliding ones (``slide``) or sessions (``session_gap``).

    Rows later than the watermark are dropped by the engine once their window is closed.
    """
    d = event_time(events, order).withWatermark(order, watermark)
    if session_gap is not None:
        w = F.session_window(order, session_gap)
    else:
        w = F.window(order, every, slide) if slide else F.window(order, every)
    g = d.groupBy(*key, w.alias("w")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"),
        F.avg(value).alias("mean"), F.count(value).alias("volume"),
    )
    return g.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "mean", "volume")


def dedupe(stream: DataFrame, key: Sequence[str] = ("event_type",), order: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """First row per (key, time) within the watermark."""
    d = event_time(stream, order).withWatermark(order, watermark)
    return d.dropDuplicatesWithinWatermark([*key, order]) if stream.isStreaming else d.dropDuplicates([*key, order])


def with_reason(stream: DataFrame, cols: Sequence[str] = ("value",), key: Sequence[str] = ("event_type",), order: str = "ts") -> DataFrame:
    """Adds ``reason``: what makes a row unfit for use, NULL where it is fit."""
    bad = F.when(F.col(order).isNull(), "missing time")
    for k in key:
        bad = bad.when(F.col(k).isNull(), f"missing {k}")
    for c in cols:
        bad = bad.when(F.col(c).isNull() | F.isnan(c), f"missing {c}")
    return stream.withColumn("reason", bad)


def quarantine(stream: DataFrame, cols: Sequence[str] = ("value",), key: Sequence[str] = ("event_type",), order: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows fit for use, and rejected rows with the reason. The minimum history is held back by the update itself."""
    d = with_reason(stream, cols, key, order)
    return d.filter(F.col("reason").isNull()).drop("reason"), d.filter(F.col("reason").isNotNull())
