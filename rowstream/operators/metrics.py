"""Counters, gauges and alerts of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowstream.config import StreamConfig
from rowstream.operators.filters import schema_events
from rowstream.operators.normalize import is_row


def table_counts(events: DataFrame) -> DataFrame:
    return events.where(is_row()).groupBy("tbl").agg(F.count("*").alias("events"))


def statement_counts(events: DataFrame) -> DataFrame:
    return schema_events(events).groupBy("query").agg(F.count("*").alias("events"))


def windowed_counts(events: DataFrame, config: StreamConfig, time: str = "ts", late: str | None = None) -> DataFrame:
    """Counts by table and tumbling window; ``late`` sets a watermark, for streams."""
    rows = events.where(is_row())
    rows = rows.withWatermark(time, late) if late else rows
    return rows.groupBy(F.window(time, f"{config.counter_window_seconds} seconds"), "tbl").agg(F.count("*").alias("events"))


def delay_gauge(beats: DataFrame, config: StreamConfig, delay: Column, time: str = "ts") -> DataFrame:
    """The greatest delay by window."""
    return beats.groupBy(F.window(time, f"{config.gauge_window_seconds} seconds")).agg(F.max(delay).alias("delay_seconds"))


def delay_alerts(gauge: DataFrame, config: StreamConfig) -> DataFrame:
    return gauge.where(F.col("delay_seconds") > config.max_delay_seconds)


def progress_timings(query) -> dict[str, int]:
    """How long the parts of a streaming query's last batch took, in milliseconds."""
    last = query.lastProgress
    return dict(last["durationMs"]) if last else {}
