"""From log events to one row per changed row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowstream.config import ADMITTED_KINDS, REFRESH_SUFFIX, ROW_KINDS, StreamConfig, only_tables


def admit(events: DataFrame) -> DataFrame:
    """Only the kinds of events that a stream carries; rows without a kind are no events."""
    return events.where(F.col("kind").isin(*ADMITTED_KINDS))


def is_row(kind: Column | None = None) -> Column:
    return (F.col("kind") if kind is None else kind).isin(*ROW_KINDS)


def whitelist(events: DataFrame, config: StreamConfig) -> DataFrame:
    """Row events of listed tables and their refresh tables. Statements pass, and so do position markers, without which
    positions would stand still."""
    tables = only_tables(config.table_whitelist)
    if tables is None:
        return events
    return events.where(~is_row() | F.col("tbl").isin(*tables) | (F.col("db") == config.heartbeat_db))


def flatten_rows(events: DataFrame) -> DataFrame:
    """One row for each row image of an event, numbered by ``row_idx`` in the event's order. Other events keep one row
    with number 0; a row event without images gives none."""
    some = ~is_row() | (F.size("rows") > 0)
    rest = [c for c in events.columns if c != "rows"]
    return events.where(some).select(*rest, F.posexplode_outer("rows").alias("row_idx", "row")).withColumn("row_idx", F.coalesce("row_idx", F.lit(0)))


def message_type(kind: Column, tbl: Column) -> Column:
    """create, update or delete; refresh for any row of a refresh table; null for other events."""
    by_kind = F.when(kind == "write", "create").when(kind == "update", "update").when(kind == "delete", "delete")
    return F.when(by_kind.isNotNull() & F.coalesce(tbl.endswith(REFRESH_SUFFIX), F.lit(False)), "refresh").otherwise(by_kind)


def base_table(tbl: Column) -> Column:
    """The table that a refresh table stands for."""
    return F.when(tbl.endswith(REFRESH_SUFFIX), F.substring(tbl, F.lit(1), F.length(tbl) - len(REFRESH_SUFFIX))).otherwise(tbl)


def with_message_type(events: DataFrame) -> DataFrame:
    return events.withColumn("message_type", message_type(F.col("kind"), F.col("tbl"))).withColumn("tbl", F.when(is_row(), base_table(F.col("tbl"))).otherwise(F.col("tbl")))


def after_image(row: Column) -> Column:
    return F.coalesce(row["values"], row["after_values"])


def before_image(row: Column, kind: Column) -> Column:
    """The image before an update; refreshes have none."""
    return F.when(kind == "update", row["before_values"])


def normalize(raw: DataFrame, config: StreamConfig) -> DataFrame:
    """Admit, list, flatten and type the events of a log."""
    return with_message_type(flatten_rows(whitelist(admit(raw), config)))
