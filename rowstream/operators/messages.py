"""Message envelopes, routing and publication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowstream.config import StreamConfig
from rowstream.functions.types import project_json
from rowstream.operators.filters import data_events, drop_blacklisted


def namespace(environment: str, cluster: str, db: Column) -> Column:
    return F.concat_ws(".", F.lit(environment), F.lit(cluster), db)


def topic(environment: str, cluster: str, db: Column, tbl: Column) -> Column:
    """One topic for each namespace and table."""
    return F.concat_ws(".", namespace(environment, cluster, db), tbl)


def message_key(image: Column, primary_key: Column) -> Column:
    """The primary key's columns of an image (a JSON object), as JSON; tables without one have no key."""
    values = F.from_json(image, "map<string,variant>")
    some = image.isNotNull() & (F.size(primary_key) > 0)
    return F.when(some, F.to_json(F.map_filter(values, lambda k, _: F.array_contains(primary_key, k))))


def log_transaction(cluster: str, log_file: Column, log_pos: Column) -> Column:
    """A transaction's id by place. A cluster that is no text is an error; so is a place that is no number, by its cast."""
    if not isinstance(cluster, str):
        raise TypeError("the cluster's name must be text")
    return F.struct(F.lit(cluster).alias("cluster_name"), log_file.cast("string").alias("log_file"), log_pos.cast("long").alias("log_pos"))


def global_transaction(cluster: str, gtid: Column) -> Column:
    return F.struct(F.lit(cluster).alias("cluster_name"), gtid.cast("string").alias("gtid"))


def transaction(config: StreamConfig) -> Column:
    p = F.col("position")
    return global_transaction(config.logical_cluster, p["gtid"]) if config.gtid_enabled else log_transaction(config.logical_cluster, p["log_file"], p["log_pos"])


def upstream_position(config: StreamConfig) -> Column:
    return F.struct(F.col("position"), F.lit(config.logical_cluster).alias("cluster_name"), F.col("db").alias("database_name"), F.col("tbl").alias("table_name"))


def envelope(events: DataFrame, config: StreamConfig, payload: Column, previous: Column, schema_id: Column, keep: Sequence[str] = (), keys: Column | None = None) -> DataFrame:
    """One message for each data event; ``previous`` is kept for updates only. ``keys`` name the row; a column
    ``has_pii`` of the events goes with the message."""
    return events.select(
        *keep,
        "message_type",
        topic(config.environment, config.logical_cluster, F.col("db"), F.col("tbl")).alias("topic"),
        schema_id.cast("int").alias("schema_id"),
        (F.lit(None).cast("string") if keys is None else keys).alias("keys"),
        payload.alias("payload_data"),
        F.when(F.col("message_type") == "update", previous).alias("previous_payload_data"),
        upstream_position(config).alias("upstream_position_info"),
        (F.col("has_pii") if "has_pii" in events.columns else F.lit(False)).alias("contains_pii"),
        F.lit(config.publish_dry_run).alias("dry_run"),
        F.col("ts_epoch").alias("timestamp"),
        F.array(transaction(config)).alias("meta"),
    )


def changelog_payload(db: Column, tbl: Column, image: Column) -> Column:
    """The short form: where the row is and its ``id``, which the table must have. ``image`` is JSON."""
    found = F.get_json_object(image, "$.id")
    wrong = F.raise_error(F.concat(F.lit("the short form needs a column id in "), F.coalesce(db, F.lit("")), F.lit("."), F.coalesce(tbl, F.lit(""))))
    key = F.when(image.isNull(), F.lit(None).cast("int")).when(found.isNull(), wrong.cast("int")).otherwise(found.cast("int"))
    return F.struct(db.alias("table_schema"), tbl.alias("table_name"), key.alias("id"))


def data_messages(events: DataFrame, config: StreamConfig, versions: DataFrame | None = None, keep: Sequence[str] = (), pii: DataFrame | None = None) -> DataFrame:
    """The data handler: blacklist, schema version, typed payload, envelope.

    With ``versions``, images are brought into message form by the columns that their table has at their place in the
    log, and messages carry its primary key; without, they stay as they are. In changelog mode they are reduced to the
    short form under one fixed schema. ``pii`` lists the tables (db, tbl) whose messages hold personal data.
    """
    rows = data_events(drop_blacklisted(events, config))
    rows = rows if pii is None else with_pii_flag(rows, pii)
    after, before = F.col("after_image"), F.col("before_image")
    if config.changelog_mode:
        short = lambda image: F.to_json(changelog_payload(F.col("db"), F.col("tbl"), image))
        return envelope(rows, config, short(after), short(before), F.lit(1), keep)
    if versions is None:
        return envelope(rows, config, after, before, F.lit(1), keep)
    from rowstream.operators.catalog import with_definition, with_schema_version

    rows = with_definition(with_schema_version(rows, versions), versions)
    types, key = F.col("column_types"), message_key(F.coalesce(after, before), F.col("primary_key"))
    return envelope(rows, config, project_json(after, types), project_json(before, types), F.col("schema_id"), keep, key)


def with_pii_flag(events: DataFrame, listed: DataFrame) -> DataFrame:
    """Whether a table holds personal data; tables that aren't listed don't. ``listed``: db, tbl, one row a table."""
    flags = listed.select("db", "tbl").distinct().withColumn("has_pii", F.lit(True))
    return events.join(flags, ["db", "tbl"], "left").withColumn("has_pii", F.coalesce("has_pii", F.lit(False)))


def encrypt_payload(messages: DataFrame, key: Column) -> DataFrame:
    """Payloads of tables with personal data, encrypted."""
    return messages.withColumn("payload_data", F.when(F.col("has_pii"), F.base64(F.aes_encrypt("payload_data", key, F.lit("GCM")))).otherwise(F.col("payload_data")))


def unpublished(replay: DataFrame, published: DataFrame, on: Sequence[str]) -> DataFrame:
    """Messages of a replay that a topic doesn't hold yet."""
    return replay.join(published.select(*on), list(on), "left_anti")


def write_topics(messages: DataFrame, path: str, batch: int, run: str = "direct") -> None:
    """Publish one batch of a run: its folder is replaced, so a repeated batch changes nothing."""
    messages.write.mode("overwrite").partitionBy("topic").parquet(f"{path}/run={run}/batch={batch}")
