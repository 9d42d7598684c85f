"""Replay positions: the last marker at or before an event, and how many events came since.

The order is total, but no task sees all of it: a log file is one segment. Windows run within a file; what a file
carries over (its last marker and the events since) is one row per file, counted apart, scanned in file order and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowstream.config import StreamConfig
from rowstream.operators.normalize import is_row
from rowstream.schema import ORDER

_CARRIED = ("gtid", "log_file", "log_pos", "hb_serial", "hb_timestamp")


def is_marker(config: StreamConfig) -> Column:
    """A transaction's GTID, or any row event of the heartbeat database."""
    if config.gtid_enabled:
        return F.col("kind") == "gtid"
    return is_row() & F.coalesce(F.col("db") == config.heartbeat_db, F.lit(False))


def marker_position(config: StreamConfig) -> Column:
    """What a marker sets: its GTID, or its place in the log and the heartbeat's serial and time."""
    if config.gtid_enabled:
        return F.struct(F.col("gtid"), F.lit(None).cast("string").alias("log_file"), *[F.lit(None).cast("long").alias(c) for c in _CARRIED[2:]])
    return F.struct(
        F.lit(None).cast("string").alias("gtid"), F.col("log_file"), F.col("log_pos").cast("long").alias("log_pos"), F.col("hb_serial").cast("long").alias("hb_serial"), F.col("hb_timestamp").cast("long").alias("hb_timestamp")
    )


def assign_positions(events: DataFrame, config: StreamConfig, order: tuple[str, ...] = ORDER, segment: str = "log_file") -> DataFrame:
    """Add ``position`` (null parts before the first marker, offset counted from the start) and drop the markers.

    ``events`` needs kind, db, gtid, hb_serial, hb_timestamp and the order's columns. In heartbeat mode GTID events are
    dropped first.
    """
    if not config.gtid_enabled:
        events = events.where(F.col("kind") != "gtid")
    marked = events.withColumn("__marker", F.when(is_marker(config), marker_position(config)))
    within = Window.partitionBy(segment).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("__epoch", F.count("__marker").over(so_far))
    marked = marked.withColumn("__last", F.last("__marker", ignorenulls=True).over(so_far))
    marked = marked.withColumn("__nth", F.row_number().over(Window.partitionBy(segment, "__epoch").orderBy(*order)).cast("long"))

    # one row per segment: its last marker, and how many events follow it (all, if it has none); two scans of few
    # columns that are counted before any shuffle, so that the events themselves are brought in order once
    key = F.struct(*order)
    marks = events.where(is_marker(config)).select(F.col(segment).alias("__segment"), marker_position(config).alias("__own"), key.alias("__at"))
    ends = marks.groupBy("__segment").agg(F.max_by("__own", "__at").alias("own"), F.max("__at").alias("__at"))
    after = F.when(F.col("__at").isNull() | (key > F.col("__at")), 1)
    tails = events.join(ends, F.col(segment) == F.col("__segment"), "left").groupBy(F.col(segment).alias("__file")).agg(F.count(after).alias("tail"))
    files = tails.join(ends, F.col("__file") == F.col("__segment"), "left").select(F.col("__file").alias("__segment"), "own", F.when(F.col("own").isNotNull(), 1).otherwise(0).alias("markers"), "tail")
    in_order = Window.orderBy("__segment")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("__group", F.count(F.when(F.col("markers") > 0, 1)).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    files = files.withColumn("__came", F.last("own", ignorenulls=True).over(before))
    files = files.withColumn("__run", F.sum("tail").over(Window.partitionBy("__group").orderBy("__segment")))
    files = files.select("__segment", "__came", F.coalesce(F.lag("__run").over(in_order), F.lit(0)).alias("__carry"))

    joined = marked.where(F.col("__marker").isNull()).join(files, F.col(segment) == F.col("__segment"))
    first = F.col("__epoch") == 0
    came = F.when(first, F.col("__came")).otherwise(F.col("__last"))
    # the marker itself is the first row of its epoch
    offset = F.when(first, F.col("__carry") + F.col("__nth") - 1).otherwise(F.col("__nth") - 2)
    position = F.struct(came["gtid"].alias("gtid"), came["log_file"].alias("log_file"), came["log_pos"].alias("log_pos"), offset.alias("offset"), came["hb_serial"].alias("hb_serial"), came["hb_timestamp"].alias("hb_timestamp"))
    return joined.withColumn("position", position).drop("__marker", "__epoch", "__last", "__nth", "__segment", "__came", "__carry")


def skip_to(events: DataFrame, saved: Column, config: StreamConfig) -> DataFrame:
    """Drop what was read before: of the saved marker's events those up to the saved offset, which is one more than the
    offset. ``events`` start at the saved marker."""
    p = F.col("position")
    same = p["gtid"].eqNullSafe(saved["gtid"]) if config.gtid_enabled else p["log_file"].eqNullSafe(saved["log_file"]) & p["log_pos"].eqNullSafe(saved["log_pos"])
    return events.where(~(same & saved["offset"].isNotNull() & (p["offset"] <= saved["offset"])))


def seek(events: DataFrame, log_file: str, log_pos: int) -> DataFrame:
    """Events from a place in the log on. The comparison of files reaches the scan."""
    return events.where((F.col("log_file") > log_file) | ((F.col("log_file") == log_file) & (F.col("log_pos") >= log_pos)))


def log_files(events: DataFrame) -> DataFrame:
    return events.select("log_file").distinct()


def latest_position(events: DataFrame) -> DataFrame:
    """One row: the last file and place."""
    last = F.max(F.struct("log_file", F.col("log_pos").cast("long").alias("log_pos")))
    return events.agg(last.alias("last")).select("last.log_file", "last.log_pos")
