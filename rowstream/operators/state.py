"""State tables: upserts, dumps and their files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowstream.schema import CHECKPOINT, GLOBAL_STATE, SCHEMA_DUMP, STATEMENT


def upsert_global_state(current: DataFrame, changes: DataFrame) -> DataFrame:
    """One row for each cluster: the change where there is one. Several changes for a cluster are an error."""
    one = changes.groupBy("cluster_name").agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in changes.columns if c != "cluster_name"])
    one = one.withColumn("__ok", F.assert_true(F.col("__n") == 1, F.lit("one state for a cluster"))).where(F.col("__ok").isNull()).drop("__n", "__ok")
    kept = current.join(one.select("cluster_name"), "cluster_name", "left_anti")
    return kept.unionByName(one.select(*current.columns))


def upsert_offsets(current: DataFrame, changes: DataFrame, now) -> DataFrame:
    """Offsets by cluster and topic: new ones are inserted, changed ones take the time ``now``, equal ones stay as they are."""
    old = current.select("cluster_name", "topic", F.col("topic_offset").alias("__old"), F.col("time_created").alias("__created"), F.col("time_updated").alias("__updated"))
    new = changes.select("cluster_name", "topic", F.col("topic_offset").alias("__new"))
    both = old.join(new, ["cluster_name", "topic"], "full_outer")
    moved = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("__old"))
    return both.select(
        "cluster_name",
        "topic",
        F.coalesce("__new", "__old").alias("topic_offset"),
        F.coalesce("__created", now).cast("long").alias("time_created"),
        F.when(moved, now).otherwise(F.col("__updated")).cast("long").alias("time_updated"),
    )


def offsets_map(checkpoints: DataFrame) -> DataFrame:
    """cluster_name and the map from topic to offset."""
    pairs = F.array_sort(F.collect_list(F.struct("topic", "topic_offset")))
    return checkpoints.groupBy("cluster_name").agg(F.map_from_entries(pairs).alias("offsets"))


def last_created(checkpoints: DataFrame, cluster: str) -> DataFrame:
    """The offset of a cluster that was inserted last, as a top-k; of those inserted together, the first topic's."""
    return checkpoints.where(F.col("cluster_name") == cluster).orderBy(F.desc("time_created"), "topic").limit(1)


class StateStore:
    """State tables in a folder. A save writes a new generation and then a pointer to it under the next number; readers
    take the pointer of the highest number. Nothing is changed in place, so a failure at any point leaves the generation
    before, and of two writers that save at once one fails."""

    SCHEMAS = {"global_state": GLOBAL_STATE, "checkpoints": CHECKPOINT, "dumps": SCHEMA_DUMP, "statements": STATEMENT}
    #: Pointers that are kept.
    KEPT = 3

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        sc = self.spark.sparkContext
        make = lambda name: sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return make, make("x").getFileSystem(sc._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        make, fs = self._fs()
        return sorted(f.getPath().getName() for f in fs.globStatus(make("CURRENT-[0-9]*")) or [])

    def generations(self) -> dict[str, str]:
        pointers = self._pointers()
        return json.loads(self.spark.read.text(f"{self.path}/{pointers[-1]}", wholetext=True).first()[0]) if pointers else {}

    def read(self, table: str) -> DataFrame:
        name = self.generations().get(table)
        schema = self.SCHEMAS[table]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], schema)

    def save(self, **tables: DataFrame) -> None:
        """Replace the named tables together: all of them, or none if this fails."""
        pointers, known = self._pointers(), self.generations()
        names = {t: f"{t}-{uuid.uuid4().hex}" for t in tables}
        for t, df in tables.items():
            df.write.parquet(f"{self.path}/{names[t]}")
        make, fs = self._fs()
        fresh = make(f"NEXT-{uuid.uuid4().hex}")
        stream = fs.create(fresh, False)
        stream.write(bytearray(json.dumps(known | names).encode()))
        stream.close()
        last = int(pointers[-1].rpartition("-")[2]) if pointers else 0
        where = make(f"CURRENT-{last + 1:016d}")
        if fs.exists(where) or not fs.rename(fresh, where):
            raise OSError(f"{where.toString()} was written by another")
        for old in pointers[: -self.KEPT]:
            fs.delete(make(old), False)

    @contextmanager
    def writing(self, cluster: str) -> Iterator[None]:
        """Only one writer for a cluster at a time. What a killed writer leaves is removed by :meth:`unlock`."""
        make, fs = self._fs()
        lock = make(f"LOCK-{cluster}")
        try:
            fs.create(lock, False).close()
        except Exception as e:
            raise RuntimeError(f"{cluster} has a writer, by {lock.toString()}") from e
        try:
            yield
        finally:
            fs.delete(lock, False)

    def unlock(self, cluster: str) -> None:
        make, fs = self._fs()
        fs.delete(make(f"LOCK-{cluster}"), False)

    # --- what a stream keeps ---------------------------------------------------------------------------------------

    def save_position(self, cluster: str, position: str | None, offsets: dict[str, int], now: int, clean: bool = False, event_type: str = "data_event", db: str | None = None, tbl: str | None = None, statements: DataFrame | None = None) -> None:
        """State, topic offsets and the schema statements read so far, in one generation. Without a published position
        there are statements only to save."""
        more = {} if statements is None else {"statements": statements}
        if position is None:
            if more:
                self.save(**more)
            return
        state = self.spark.createDataFrame([(cluster, position, clean, event_type, db, tbl, now)], GLOBAL_STATE)
        made = more | {"global_state": upsert_global_state(self.read("global_state"), state)}
        if offsets:
            changes = self.spark.createDataFrame([(cluster, t, o) for t, o in sorted(offsets.items())], "cluster_name string, topic string, topic_offset long")
            made["checkpoints"] = upsert_offsets(self.read("checkpoints"), changes, F.lit(now))
        self.save(**made)

    def state(self, cluster: str):
        rows = self.read("global_state").where(F.col("cluster_name") == cluster).take(2)
        if len(rows) > 1:
            raise ValueError(f"more than one state for {cluster}")
        return rows[0] if rows else None

    def offsets(self, cluster: str) -> dict[str, int]:
        row = offsets_map(self.read("checkpoints").where(F.col("cluster_name") == cluster)).first()
        return dict(row["offsets"]) if row else {}

    def statements(self, cluster: str) -> DataFrame:
        return self.read("statements").where(F.col("cluster_name") == cluster)

    def latest_checkpoint(self, cluster: str):
        """The topic offset that was inserted last, or None."""
        return last_created(self.read("checkpoints"), cluster).first()

    def dump_exists(self, cluster: str) -> bool:
        return not self.read("dumps").where(F.col("cluster_name") == cluster).limit(1).isEmpty()

    def latest_dump(self, cluster: str) -> str:
        row = self.read("dumps").where(F.col("cluster_name") == cluster).first()
        if row is None:
            raise LookupError(f"no schema dump of {cluster}")
        return row["database_dump"]

    def replace_dump(self, cluster: str, dump: str) -> None:
        kept = self.read("dumps").where(F.col("cluster_name") != cluster)
        self.save(dumps=kept.unionByName(self.spark.createDataFrame([(cluster, dump)], SCHEMA_DUMP)))

    def delete_dump(self, cluster: str) -> None:
        self.save(dumps=self.read("dumps").where(F.col("cluster_name") != cluster))


class SchemaDump:
    """Two steps: ``create`` takes the dump, ``persist`` stores it. Either out of turn is an error."""

    def __init__(self, store: StateStore, cluster: str) -> None:
        self.store, self.cluster, self.taken = store, cluster, None

    def create(self, catalog: DataFrame) -> None:
        if self.taken is not None:
            raise ValueError("a dump was taken and isn't stored yet")
        rows = catalog.orderBy("db", "tbl").toJSON().collect()  # one row a table
        self.taken = "\n".join(rows)

    def persist(self) -> None:
        if self.taken is None:
            raise ValueError("no dump was taken")
        self.store.replace_dump(self.cluster, self.taken)
        self.taken = None

    def restore(self, schema) -> DataFrame:
        """The catalog as it was dumped."""
        spark = self.store.spark
        lines = spark.createDataFrame([(line,) for line in self.store.latest_dump(self.cluster).splitlines()], "line string")
        return lines.select(F.from_json("line", schema).alias("r")).select("r.*")
