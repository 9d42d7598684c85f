"""Command line: ``python -m rowstream stream`` and ``python -m rowstream heartbeat``."""

from __future__ import annotations

import argparse
import signal
import sys

from pyspark.sql import functions as F

from rowstream.config import StreamConfig
from rowstream.functions.position import printable
from rowstream.operators import heartbeat
from rowstream.operators.state import StateStore
from rowstream.session import build_session
from rowstream.sources.binlog import captured
from rowstream.streaming.pipeline import ChangeStream, prepared
from rowstream.streaming.positioner import STORE


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rowstream", description=__doc__)
    parser.add_argument("--config", action="append", default=[], help="YAML file; later ones win")
    commands = parser.add_subparsers(dest="command", required=True)
    stream = commands.add_parser("stream", help="tail a capture and publish its messages")
    for name in ("log", "topics", "state", "checkpoint"):
        stream.add_argument(name)
    stream.add_argument("--force", action="store_true", help="take over from a writer that was killed")
    stream.add_argument("--once", action="store_true", help="stop when all that is there is published")
    beat = commands.add_parser("heartbeat", help="find the place of a heartbeat")
    beat.add_argument("log")
    beat.add_argument("timestamp", type=int)
    beat.add_argument("serial", type=int)
    given = parser.parse_args(args)
    config = StreamConfig.from_yaml(*given.config)
    spark = build_session(spark__sql__streaming__stateStore__providerClass=STORE)
    if given.command == "heartbeat":
        found = heartbeat.search(prepared(captured(spark, given.log), config), config, given.timestamp, given.serial)
        row = found.select(printable(F.col("hb_serial"), F.col("hb_timestamp"), F.col("log_file"), F.col("log_pos")).alias("text")).first()
        print(row["text"] if row else "no such heartbeat")
        return 0 if row else 1
    store = StateStore(spark, given.state)
    if given.force:
        store.unlock(config.cluster)
    with store.writing(config.cluster):
        change = ChangeStream(spark, config, store, given.topics)
        query = change.start(captured(spark, given.log, stream=True), given.checkpoint, once=given.once, log=captured(spark, given.log))
        signal.signal(signal.SIGTERM, lambda *_: change.stop(query))
        query.awaitTermination()
        change.stop(query)
    return 0


if __name__ == "__main__":
    sys.exit(main())
