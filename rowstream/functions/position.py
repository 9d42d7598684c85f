"""Positions as columns: replay dictionaries, GTID sets and printable forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = ("gtid", "log_file", "log_pos", "offset", "hb_serial", "hb_timestamp")


def gtid_set(gtid: Column) -> Column:
    """``sid:N`` as the set of all transactions up to N."""
    return F.concat(F.substring_index(gtid, ":", 1), F.lit(":1-"), F.element_at(F.split(gtid, ":"), 2))


def next_gtid_set(gtid: Column) -> Column:
    """``sid:N`` as the set up to N + 1, so that the next transaction is the first one read."""
    return F.concat(F.substring_index(gtid, ":", 1), F.lit(":1-"), (F.element_at(F.split(gtid, ":"), 2).cast("long") + 1).cast("string"))


def replay_set(gtid: Column, offset: Column) -> Column:
    """Where to resume: inside the transaction if it has an offset, else after it."""
    return F.when(offset.isNotNull() & (offset != 0), gtid_set(gtid)).otherwise(next_gtid_set(gtid))


def to_saved(position: Column) -> Column:
    """The JSON that is saved. A GTID position drops an offset of 0; a log position keeps it and needs file and place
    together; a heartbeat needs serial and time together, neither of them 0."""
    by_gtid = F.coalesce(position["gtid"], F.lit("")) != ""
    both = position["log_file"].isNotNull() & position["log_pos"].isNotNull()
    beat = (F.coalesce(position["hb_serial"], F.lit(0)) != 0) & (F.coalesce(position["hb_timestamp"], F.lit(0)) != 0)
    offset = F.when(by_gtid, F.when(position["offset"] != 0, position["offset"])).otherwise(position["offset"])
    return F.to_json(
        F.struct(
            F.when(by_gtid, position["gtid"]).alias("gtid"),
            F.when(~by_gtid & both, position["log_file"]).alias("log_file"),
            F.when(~by_gtid & both, position["log_pos"]).alias("log_pos"),
            offset.alias("offset"),
            F.when(~by_gtid & beat, position["hb_serial"]).alias("hb_serial"),
            F.when(~by_gtid & beat, position["hb_timestamp"]).alias("hb_timestamp"),
        )
    )


def from_saved(saved: Column) -> Column:
    """A position from its JSON: by GTID if there is one, else by file and place, which both must be there."""
    p = F.from_json(saved, "gtid string, log_file string, log_pos long, offset long, hb_serial long, hb_timestamp long")
    valid = p["gtid"].isNotNull() | (p["log_file"].isNotNull() & p["log_pos"].isNotNull())
    return F.when(valid, p).otherwise(F.raise_error(F.concat(F.lit("not a position: "), F.coalesce(saved, F.lit("null")))))


def to_replication(position: Column) -> Column:
    """What a reader is opened with: ``auto_position`` for a GTID, else file and place."""
    by_gtid = F.coalesce(position["gtid"], F.lit("")) != ""
    return F.struct(
        F.when(by_gtid, replay_set(position["gtid"], position["offset"])).alias("auto_position"),
        F.when(~by_gtid, position["log_file"]).alias("log_file"),
        F.when(~by_gtid, position["log_pos"]).alias("log_pos"),
    )


def printable(serial: Column, timestamp: Column, log_file: Column, log_pos: Column) -> Column:
    """A heartbeat position for people, one part in a line."""
    return F.format_string("heartbeat serial: %s\nheartbeat timestamp: %s\nlog file: %s\nlog position: %s", serial.cast("string"), timestamp.cast("string"), log_file, log_pos.cast("string"))


def struct_of(**parts: Column) -> Column:
    """A position struct; parts that aren't named are null."""
    kinds = {"gtid": "string", "log_file": "string"}
    return F.struct(*[parts.get(p, F.lit(None)).cast(kinds.get(p, "long")).alias(p) for p in _PARTS])
