"""Epoch seconds, dates and state codecs as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for the last date there is.
FOREVER = (1 << 63) - 1


def to_epoch(value: Column, zone: str = "UTC") -> Column:
    """Epoch seconds of a naive time in ``zone``."""
    return F.unix_timestamp(F.to_utc_timestamp(value.cast("timestamp"), zone))


def from_epoch(value: Column) -> Column:
    return F.timestamp_seconds(value)


def date_to_epoch(value: Column) -> Column:
    """Epoch seconds of a day's begin; the last date there is has no end."""
    return F.when(value == F.lit("9999-12-31").cast("date"), F.lit(FOREVER)).otherwise(F.unix_timestamp(value.cast("timestamp")))


def epoch_to_date(value: Column) -> Column:
    return F.timestamp_seconds(value).cast("date")


def date_to_datetime(value: Column) -> Column:
    return value.cast("timestamp_ntz")


def now_in_seconds() -> Column:
    return F.date_trunc("second", F.current_timestamp())


def delay_seconds(heartbeat: Column, now: Column | None = None) -> Column:
    """How far behind the source a stream is that has just seen ``heartbeat`` (epoch seconds)."""
    return (F.unix_timestamp(F.current_timestamp()) if now is None else now) - heartbeat
