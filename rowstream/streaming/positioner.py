"""Positions in a stream: the last marker and the events since, kept as state by cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from rowstream.config import ROW_KINDS, StreamConfig
from rowstream.schema import ORDER, POSITION

_STATE = "gtid string, log_file string, log_pos long, hb_serial long, hb_timestamp long, seen long"
_PARTS = ("gtid", "log_file", "log_pos", "hb_serial", "hb_timestamp")

#: The state store that keeps processors' state on disk.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _some(value):
    return None if pd.isna(value) else value


class Positioner(StatefulProcessor):
    """Batches arrive in log order; the rows of one are sorted here."""

    def __init__(self, config: StreamConfig, columns: list[str]) -> None:
        self.config, self.columns = config, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True).sort_values(list(ORDER), kind="stable")
        config = self.config
        if config.gtid_enabled:
            marker = events["kind"] == "gtid"
        else:
            events = events[events["kind"] != "gtid"]
            marker = events["kind"].isin(ROW_KINDS) & (events["db"] == config.heartbeat_db)
        last = self.state.get() if self.state.exists() else None
        parts = dict(zip(_PARTS, last[:5], strict=True)) if last else dict.fromkeys(_PARTS)
        seen = int(last[5]) if last else 0

        epoch = marker.cumsum().to_numpy()
        nth = events.groupby(epoch).cumcount().to_numpy()
        offset = nth - 1
        offset[epoch == 0] = nth[epoch == 0] + seen
        marks = events[marker]
        table = [parts]
        for m in marks.itertuples():
            if config.gtid_enabled:
                table.append({**dict.fromkeys(_PARTS), "gtid": m.gtid})
            else:
                table.append({"gtid": None, "log_file": m.log_file, "log_pos": int(m.log_pos), "hb_serial": _some(m.hb_serial), "hb_timestamp": _some(m.hb_timestamp)})
        end = table[-1]
        left = int((epoch == len(marks)).sum()) - (1 if len(marks) else -seen)
        self.state.update((end["gtid"], end["log_file"], end["log_pos"], None if end["hb_serial"] is None else int(end["hb_serial"]), None if end["hb_timestamp"] is None else int(end["hb_timestamp"]), left))
        out = events[self.columns].copy()
        frame = pd.DataFrame([table[e] for e in epoch], columns=list(_PARTS), index=events.index)
        for c in _PARTS:
            out[f"pos_{c}"] = frame[c].astype("Int64") if c in ("log_pos", "hb_serial", "hb_timestamp") else frame[c].astype(object)
        out["pos_offset"] = offset
        for c in out.columns:
            if out[c].dtype == object:
                out[c] = out[c].where(out[c].notna(), None)
        yield out[~marker.to_numpy()]

    def close(self) -> None:
        pass


def assign_positions_stream(events: DataFrame, config: StreamConfig) -> DataFrame:
    """Like the batch operator, for a stream of events with a column ``cluster``."""
    columns = list(events.columns)
    flat = [StructField(f"pos_{c}", POSITION[c].dataType) for c in (*_PARTS, "offset")]
    out = StructType([*events.schema.fields, *flat])
    placed = events.groupBy("cluster").transformWithStateInPandas(Positioner(config, columns), out, "Append", "none")
    position = F.struct(*[F.col(f"pos_{c}").alias(c) for c in POSITION.fieldNames()])
    return placed.withColumn("position", position).drop(*[f.name for f in flat])
