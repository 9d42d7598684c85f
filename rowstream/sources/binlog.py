"""A source that replays captured change logs, in batch and as a stream.

A capture is a folder of JSON-lines files, one for each log file, named as the log file with ``.jsonl``; a line is an
event of ``schema.RAW_EVENT``. Register with ``spark.dataSource.register(BinlogSource)`` and read with
``format("binlog")``. Options: ``path``; ``log_file`` and ``log_pos`` to start from; ``resume`` (false: from the log's
begin); ``tables``, a comma-separated list that row events are held against; ``span_bytes``, the most bytes of a file
that one task reads.

Offsets are byte positions of whole lines, so a reader never goes back, reads nothing twice, and leaves a line that is
still being written for later.

Readers open files with the local file system's calls, so the folder must be mounted on every executor. Captures in a
store that only Spark reads go through :func:`captured`, which needs no such folder.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from rowstream.config import ADMITTED_KINDS, ROW_KINDS, only_tables
from rowstream.schema import RAW_EVENT


def captured(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int = 4) -> DataFrame:
    """A capture through Spark's own readers: splittable, pruned, and at home in any store. A stream takes some files at
    a time, as positions are given in order."""
    reader = (spark.readStream.option("maxFilesPerTrigger", files_per_batch) if stream else spark.read).schema(RAW_EVENT)
    return reader.json(path).where(F.col("kind").isin(*ADMITTED_KINDS))


def _files(path: str) -> list[str]:
    return sorted(f for f in os.listdir(path) if f.endswith(".jsonl"))


class _Span(InputPartition):
    """The lines of a file that begin at bytes ``first`` to ``last`` (not included)."""

    def __init__(self, file: str, first: int, last: int) -> None:
        super().__init__(file)
        self.file, self.first, self.last = file, first, last


class _Reading:
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        resume = options.get("resume", "true").lower() != "false"
        self.log_file = options.get("log_file", "") if resume else ""
        self.log_pos = int(options.get("log_pos", "0")) if resume else 0
        listed = [t for t in options.get("tables", "").split(",") if t]
        self.tables = only_tables(listed)
        self.marker_db = options.get("heartbeat_db", "heartbeat")
        self.span_bytes = int(options.get("span_bytes", str(64 << 20)))

    def lines(self, span: _Span) -> Iterator[bytes]:
        with open(os.path.join(self.path, span.file), "rb") as f:
            if span.first:  # a line that began before belongs to another span
                f.seek(span.first - 1)
                f.readline()
            while f.tell() < span.last:
                yield f.readline()

    def rows(self, span: _Span) -> Iterator[tuple]:
        for line in self.lines(span):
            event = json.loads(line)
            if event.get("kind") not in ADMITTED_KINDS or (event["log_file"], event["log_pos"]) < (self.log_file, self.log_pos):
                continue
            if self.tables is not None and event["kind"] in ROW_KINDS and event.get("tbl") not in self.tables and event.get("db") != self.marker_db:
                continue
            images = event.get("rows")
            rows = None if images is None else [tuple(r.get(k) for k in ("values", "before_values", "after_values")) for r in images]
            yield (*(event.get(k) for k in ("kind", "cluster", "db", "tbl", "log_file", "log_pos", "gtid", "ts_epoch", "query")), rows)

    def wanted(self) -> list[str]:
        return [f for f in _files(self.path) if f.removesuffix(".jsonl") >= self.log_file]

    def whole(self, file: str) -> int:
        """Bytes of a file up to the end of its last whole line."""
        with open(os.path.join(self.path, file), "rb") as f:
            end = f.seek(0, os.SEEK_END)
            while end:
                first = max(0, end - 4096)
                f.seek(first)
                at = f.read(end - first).rfind(b"\n")
                if at >= 0:
                    return first + at + 1
                end = first
        return 0

    def spans(self, start: dict[str, int], end: dict[str, int]) -> list[_Span]:
        cuts = [(f, a, min(a + self.span_bytes, n)) for f, n in sorted(end.items()) for a in range(start.get(f, 0), n, self.span_bytes)]
        return [_Span(*c) for c in cuts] or [_Span("", 0, 0)]

    def read(self, span: _Span) -> Iterator[tuple]:
        return self.rows(span) if span.file else iter(())


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.reading = _Reading(options)

    def partitions(self) -> list[_Span]:
        return self.reading.spans({}, {f: os.path.getsize(os.path.join(self.reading.path, f)) for f in self.reading.wanted()})

    def read(self, partition: _Span) -> Iterator[tuple]:
        return self.reading.read(partition)


class _StreamReader(DataSourceStreamReader):
    """An offset has the bytes read of each file."""

    def __init__(self, options: dict[str, str]) -> None:
        self.reading = _Reading(options)

    def initialOffset(self) -> dict:
        return {"bytes": {}}

    def latestOffset(self) -> dict:
        return {"bytes": {f: self.reading.whole(f) for f in self.reading.wanted()}}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        return self.reading.spans(start["bytes"], end["bytes"])

    def read(self, partition: _Span) -> Iterator[tuple]:
        return self.reading.read(partition)

    def commit(self, end: dict) -> None:
        pass


class BinlogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binlog"

    def schema(self) -> StructType:
        return RAW_EVENT

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))
