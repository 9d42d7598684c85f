"""The stream end to end: positioned, typed messages to topic folders, then the state that goes with them.

A batch first replaces its own folder of messages and then saves position, offsets and schema statements, so a batch
that is repeated after a failure changes nothing and nothing is published twice. If the stream's checkpoint is lost as
well, it goes on from the saved position: what was published beyond that is found in the topics and left out.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowstream.config import StreamConfig
from rowstream.functions.position import to_saved
from rowstream.operators import positioning, recovery
from rowstream.operators.catalog import schema_versions
from rowstream.operators.filters import drop_blacklisted, schema_events
from rowstream.operators.messages import data_messages, unpublished, write_topics
from rowstream.operators.normalize import after_image, before_image, normalize
from rowstream.operators.state import SchemaDump, StateStore
from rowstream.schema import BASE_TABLE, ORDER, RAW_EVENT, STATEMENT
from rowstream.streaming.positioner import assign_positions_stream

#: Stands among a cluster's topics, with the run, for the last batch whose state was saved.
LAST_BATCH = "__batch"
#: What tells a message from others of its topic.
MESSAGE = ("topic", *ORDER)


def prepared(raw: DataFrame, config: StreamConfig) -> DataFrame:
    """Normalised events with images and heartbeat values, before positions."""
    events = normalize(raw, config)
    image = after_image(F.col("row"))
    beat = F.col("db") == config.heartbeat_db
    return (
        events.withColumn("after_image", image)
        .withColumn("before_image", before_image(F.col("row"), F.col("kind")))
        .withColumn("hb_serial", F.when(beat, F.get_json_object(image, "$.serial").cast("long")))
        .withColumn("hb_timestamp", F.when(beat, F.unix_timestamp(F.get_json_object(image, "$.timestamp").cast("timestamp"))))
        .drop("row")
    )


class ChangeStream:
    """One writer for a checkpoint folder; ``topics`` is where messages go. ``pii`` lists tables with personal data.

    Schema versions start from the cluster's schema dump, if there is one, and follow the statements of the log.
    """

    def __init__(self, spark: SparkSession, config: StreamConfig, store: StateStore, topics: str, pii: DataFrame | None = None) -> None:
        self.spark, self.config, self.store, self.topics, self.pii = spark, config, store, topics.rstrip("/"), pii
        self.run = "direct"
        self.saved = None  # the position to go on from
        self.before: DataFrame | None = None  # messages of other runs beyond it

    # --- batches ---------------------------------------------------------------------------------------------------

    def publish(self, events: DataFrame, batch: int) -> None:
        marker = f"{LAST_BATCH}:{self.run}"
        known = self.store.offsets(self.config.cluster)
        if self.saved is not None:
            events = self._after(events)
        statements = self._statements(events)
        messages = data_messages(events, self.config, self._versions(statements), keep=ORDER, pii=self.pii)
        if self.before is not None:
            messages = unpublished(messages, self.before, MESSAGE)
        if not self.config.publish_dry_run:
            write_topics(messages, self.topics, batch, self.run)
            messages = self._written(batch)
        if known.get(marker, -1) >= batch:  # repeated: its state was saved before
            return
        self._save(messages, statements, known, {marker: batch})

    def _written(self, batch: int) -> DataFrame:
        """What a batch published, without reading it twice from the log; empty batches have no schema of their own."""
        schema = data_messages(self.spark.createDataFrame([], self._flat()), self.config, keep=ORDER).schema
        return self.spark.read.schema(schema).option("basePath", f"{self.topics}/run={self.run}/batch={batch}").parquet(f"{self.topics}/run={self.run}/batch={batch}")

    def _flat(self):
        placed = positioning.assign_positions(prepared(self.spark.createDataFrame([], RAW_EVENT), self.config), self.config)
        return placed.schema

    def _save(self, messages: DataFrame, statements: DataFrame, known: dict[str, int], marks: dict[str, int]) -> None:
        last = messages.agg(F.max_by("upstream_position_info", F.struct(*ORDER)).alias("last")).select(
            to_saved(F.col("last.position")).alias("saved"), "last.database_name", "last.table_name"
        ).first()
        all_statements = self.store.read("statements").unionByName(statements).distinct()
        if last is None or last["saved"] is None or last["table_name"] is None:
            if not statements.isEmpty():
                self.store.save_position(self.config.cluster, None, {}, 0, statements=all_statements)
            return
        counts = {r["topic"]: r["n"] for r in messages.groupBy("topic").agg(F.count("*").alias("n")).collect()}  # one row a topic
        offsets = {**known, **{t: known.get(t, 0) + n for t, n in counts.items()}, **marks}
        self.store.save_position(self.config.cluster, last["saved"], offsets, int(time.time()), db=last["database_name"], tbl=last["table_name"], statements=all_statements)

    # --- schema history --------------------------------------------------------------------------------------------

    def _statements(self, events: DataFrame) -> DataFrame:
        found = schema_events(drop_blacklisted(events, self.config))
        return found.select(F.lit(self.config.cluster).alias("cluster_name"), *[F.col(f.name).cast(f.dataType) for f in STATEMENT.fields[1:]])

    def _versions(self, statements: DataFrame) -> DataFrame:
        """Versions by the statements read so far and those of this batch."""
        every = self.store.statements(self.config.cluster).unionByName(statements).distinct()
        cluster = self.config.cluster
        base = SchemaDump(self.store, cluster).restore(BASE_TABLE) if self.store.dump_exists(cluster) else None
        return schema_versions(every, self.config, base)

    # --- restart ---------------------------------------------------------------------------------------------------

    def _after(self, events: DataFrame) -> DataFrame:
        """Events that come after the saved position."""
        saved = self.saved
        if saved["log_file"] is not None:
            events = positioning.seek(events, saved["log_file"], saved["log_pos"])
        place = F.struct(*[F.lit(saved[c]).cast("string" if c in ("gtid", "log_file") else "long").alias(c) for c in ("gtid", "log_file", "log_pos", "offset")])
        return positioning.skip_to(events, place, self.config)

    def _published(self, but: str) -> DataFrame | None:
        """Messages of all runs but one, from the saved position on."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.topics)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        found = self.spark.read.parquet(self.topics).where(F.col("run") != but)
        if self.saved["log_file"] is not None:
            found = positioning.seek(found, self.saved["log_file"], self.saved["log_pos"])
        return found.select(*MESSAGE)

    def recover(self, log: DataFrame) -> int:
        """After an unclean stop: publish those messages of the recovery window that no topic has, and save where it
        ends. ``log`` is the whole capture. Returns the number of messages published."""
        cluster = self.config.cluster
        events = prepared(log, self.config)
        place = positioning.latest_position(log).first()
        stop = recovery.caught_up(place["log_file"], place["log_pos"])
        if self.config.gtid_enabled:
            ends = log.where("kind = 'gtid'").agg(F.max_by("gtid", F.struct("log_file", "log_pos")).alias("last"), F.max_by(F.struct("log_file", "log_pos"), F.when(F.col("gtid") == self.saved["gtid"], 1)).alias("own")).first()
            stop = recovery.caught_up_gtid(ends["last"])
            events = positioning.seek(events, ends["own"]["log_file"], ends["own"]["log_pos"])
        elif self.saved["log_file"] is not None:
            events = positioning.seek(events, self.saved["log_file"], self.saved["log_pos"])
        window = recovery.recovery_window(self._after(positioning.assign_positions(events, self.config)), self.config, stop)
        statements = self.spark.createDataFrame([], STATEMENT)  # a window ends before a statement
        messages = data_messages(window, self.config, self._versions(statements), keep=ORDER, pii=self.pii)
        run = f"recovery-{uuid.uuid5(uuid.NAMESPACE_URL, str(self.saved))}"
        published = self._published(run)
        fresh = messages if published is None else unpublished(messages, published, MESSAGE)
        write_topics(fresh, self.topics, 0, run)
        # the window's messages are all published now: the position is that of its last one
        known = self.store.offsets(cluster)
        self._save(messages, statements, known, {})
        self.resume()
        return sum(r["count"] for r in self.spark.read.parquet(self.topics).where(F.col("run") == run).groupBy("topic").count().collect())

    def resume(self) -> None:
        """Take the saved position, if there is one, to go on from."""
        saved = recovery.resume_position(self.store, self.config)
        if saved is not None:
            found = json.loads(saved)
            # before the first marker there is an offset only; a GTID's offset of 0 isn't saved
            self.saved = {c: found.get(c) for c in ("gtid", "log_file", "log_pos")} | {"offset": found.get("offset", 0)}

    def _open(self, checkpoint: str) -> bool:
        """Take the run that a checkpoint belongs to, or begin one; whether the checkpoint has offsets."""
        jvm = self.spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/rowstream-run")
        fs = mark.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(mark):
            self.run = self.spark.read.text(mark.toString()).first()[0]
        else:
            self.run = f"run-{uuid.uuid4().hex}"
            stream = fs.create(mark, False)
            stream.write(bytearray(self.run.encode()))
            stream.close()
        return fs.exists(jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets"))

    def start(self, raw: DataFrame, checkpoint: str, once: bool = False, seconds: float = 0.1, log: DataFrame | None = None) -> StreamingQuery:
        """Start tailing. State is marked unclean until :meth:`stop`.

        With a checkpoint that has offsets, Spark repeats the batch it had begun. Without, tailing goes on after the
        saved position; after an unclean stop the recovery window of ``log``, the capture in batch, comes first.
        """
        if not self._open(checkpoint):
            self.resume()
            if self.saved is not None:
                unclean = recovery.replay_wanted(self.store, self.config.cluster)
                if unclean and log is not None:
                    self.recover(log)
                self.before = self._published(self.run) if unclean else None
        self._mark(False)
        placed = assign_positions_stream(prepared(raw, self.config), self.config)
        writer = placed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.publish).outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()

    def stop(self, query: StreamingQuery) -> None:
        """Let what is there be processed, stop, and note that all was well."""
        if query.isActive:
            query.processAllAvailable()
            query.stop()
        query.awaitTermination()
        self._mark(True)

    def _mark(self, clean: bool) -> None:
        state = self.store.state(self.config.cluster)
        if state is not None and state["is_clean_shutdown"] != clean:
            self.store.save_position(self.config.cluster, state["position"], {}, int(time.time()), clean, state["event_type"], state["database_name"], state["table_name"])
