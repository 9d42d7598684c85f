"""Heartbeats: search by time and serial, and delay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowstream.config import StreamConfig
from rowstream.functions.dates import delay_seconds


def heartbeats(events: DataFrame, config: StreamConfig) -> DataFrame:
    """Updates of the heartbeat database; the filter reaches the scan."""
    return events.where((F.col("kind") == "update") & (F.col("db") == config.heartbeat_db))


def search(events: DataFrame, config: StreamConfig, timestamp: int, serial: int) -> DataFrame:
    """The place of one heartbeat: at most one row of log_file, log_pos, hb_serial, hb_timestamp.

    First the last file whose first heartbeat is not after the wanted one, by time and then serial; then the heartbeat
    itself within that file.
    """
    beats = heartbeats(events, config).select("log_file", "log_pos", "hb_serial", "hb_timestamp")
    wanted = F.struct(F.lit(timestamp).cast("long").alias("hb_timestamp"), F.lit(serial).cast("long").alias("hb_serial"))
    first = beats.groupBy("log_file").agg(F.min_by(F.struct(F.col("hb_timestamp").cast("long"), F.col("hb_serial").cast("long")), "log_pos").alias("first"))
    start = first.where(F.col("first") <= wanted).agg(F.max("log_file").alias("log_file")).where("log_file is not null")
    exact = beats.where((F.col("hb_timestamp") == timestamp) & (F.col("hb_serial") == serial))
    found = exact.join(F.broadcast(start), "log_file")  # one row
    return found.orderBy("log_pos").limit(1).select("log_file", "log_pos", "hb_serial", "hb_timestamp")


def with_delay(beats: DataFrame, now: Column) -> DataFrame:
    return beats.withColumn("delay_seconds", delay_seconds(F.col("hb_timestamp"), now))
