"""After an unclean stop: what to replay, and where to start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowstream.config import StreamConfig
from rowstream.operators.filters import drop_blacklisted, skippable
from rowstream.operators.normalize import is_row
from rowstream.operators.state import StateStore


def caught_up(latest_file: str, latest_pos: int) -> Column:
    """Whether the marker that an event carries is at or after the source's latest place, in the same file."""
    p = F.col("position")
    return F.coalesce((p["log_file"] == latest_file) & (p["log_pos"] >= latest_pos), F.lit(False))


def gtid_ordinal(gtid: Column) -> Column:
    return F.element_at(F.split(gtid, ":"), 2).cast("long")


def caught_up_gtid(latest: str) -> Column:
    """The same by transaction: of one server, the ordinal is at or after the latest one's."""
    own = F.col("position")["gtid"]
    same = F.substring_index(own, ":", 1) == latest.partition(":")[0]
    return F.coalesce(same & (gtid_ordinal(own) >= int(latest.partition(":")[2])), F.lit(False))


def recovery_window(events: DataFrame, config: StreamConfig, stop: Column, order: tuple[str, ...] = ("log_file", "log_pos", "row_idx")) -> DataFrame:
    """The data events to replay: those up to the first supported statement (left out) or the first event that has
    caught up (kept), whichever comes first, and no more than the queue holds.

    ``stop`` is true for events that have caught up. Where to end is found with two aggregates over the same exchange
    that the events come from, and only the first ``recovery_queue_size`` rows before it are sorted, as a top-k.
    """
    key = F.struct(*order)
    ddl = F.coalesce((F.col("kind") == "query") & ~skippable(F.col("query")), F.lit(False))
    # a scalar subquery: the events are brought in place once for both
    ends = F.struct(F.min(F.when(ddl, key)).alias("ddl"), F.min(F.when(is_row() & stop, key)).alias("caught"))
    end = events.agg(ends.alias("end")).scalar()
    rows = drop_blacklisted(events.where(is_row()), config)
    rows = rows.where((end["ddl"].isNull() | (key < end["ddl"])) & (end["caught"].isNull() | (key <= end["caught"])))
    return rows.orderBy(*order).limit(config.recovery_queue_size)


def need_recovery(store: StateStore, cluster: str) -> bool:
    """After an unclean stop, or if a schema dump was left."""
    state = store.state(cluster)
    return (state is not None and not state["is_clean_shutdown"]) or store.dump_exists(cluster)


def replay_wanted(store: StateStore, cluster: str) -> bool:
    """Messages are replayed after an unclean stop only."""
    state = store.state(cluster)
    return state is not None and not state["is_clean_shutdown"]


def resume_position(store: StateStore, config: StreamConfig) -> str | None:
    """The saved position, or None for the log's begin."""
    state = store.state(config.cluster) if config.resume_stream else None
    return state["position"] if state else None

