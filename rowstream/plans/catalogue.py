"""The query catalogue: one Spark plan and one SQL twin per operator.

Queries run on the simulated log (``sources.simulated``) or on the relational tables; results are flat, so that both
engines' values compare.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowstream.config import StreamConfig
from rowstream.functions import dates, ddl, position, types
from rowstream.operators import catalog, filters, heartbeat, messages, metrics, normalize, positioning, recovery, state
from rowstream.schema import BASE_TABLE, ORDER, RAW_EVENT
from rowstream.sources.simulated import LOG_SQL, change_log, gtid_log
from rowstream.streaming.pipeline import ChangeStream, prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CONFIG = StreamConfig(cluster="source", schema_blacklist=("mysql",))
GTID_CONFIG = CONFIG.with_(gtid_enabled=True)

SIM = f"sim AS ({LOG_SQL}), "
#: Positions in SQL: markers, and the events since the last one.
_POSITIONED = (
    SIM
    + """
marked AS (
  SELECT *, db = 'heartbeat' AND kind IN ('write', 'update', 'delete') AS is_marker FROM sim),
epochs AS (
  SELECT *, max(CASE WHEN is_marker THEN seq END) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS mark FROM marked),
placed AS (
  SELECT e.*, m.log_file AS pos_file, m.log_pos AS pos_log_pos, m.seq AS pos_serial, (epoch_us(m.ts) // 1000000) AS pos_time,
    row_number() OVER (PARTITION BY e.mark ORDER BY e.seq) - CASE WHEN e.mark IS NULL THEN 1 ELSE 2 END AS pos_offset
  FROM epochs e LEFT JOIN sim m ON m.seq = e.mark),
positioned AS (
  SELECT *, CASE WHEN kind = 'query' THEN NULL WHEN ends_with(tbl, '_data_pipeline_refresh') THEN 'refresh' WHEN kind = 'write' THEN 'create' ELSE kind END AS message_type,
    CASE WHEN kind <> 'query' AND ends_with(tbl, '_data_pipeline_refresh') THEN left(tbl, length(tbl) - 22) ELSE tbl END AS base
  FROM placed WHERE NOT is_marker)"""
)
_KIND_SQL = """CASE WHEN regexp_matches(query, '(?i)^\\s*create\\s+(temporary\\s+)?table\\b') THEN 'create_table'
  WHEN regexp_matches(query, '(?i)^\\s*alter\\s+table\\b') THEN 'alter_table'
  WHEN regexp_matches(query, '(?i)^\\s*drop\\s+table\\b') THEN 'drop_table'
  WHEN regexp_matches(query, '(?i)^\\s*create\\s+(database|schema)\\b') THEN 'create_database'
  WHEN regexp_matches(query, '(?i)^\\s*alter\\s+(database|schema)\\b') THEN 'alter_database'
  WHEN regexp_matches(query, '(?i)^\\s*drop\\s+(database|schema)\\b') THEN 'drop_database'
  WHEN regexp_matches(query, '(?i)^\\s*create\\s+(unique\\s+)?index\\b') THEN 'create_index'
  WHEN regexp_matches(query, '(?i)^\\s*drop\\s+index\\b') THEN 'drop_index'
  WHEN regexp_matches(query, '(?i)^\\s*rename\\s+table\\b') THEN 'rename_table' ELSE 'unsupported' END"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def positioned(spark: SparkSession, sf_dir: str, config: StreamConfig = CONFIG) -> DataFrame:
    log = gtid_log(spark, sf_dir) if config.gtid_enabled else change_log(spark, sf_dir)
    return normalize.with_message_type(positioning.assign_positions(normalize.admit(log), config))


# --- sources -------------------------------------------------------------------------------------------------------


@query(f"WITH {SIM} x AS (SELECT 1) SELECT seq, kind, log_file, log_pos FROM sim WHERE kind IN ('gtid', 'query', 'write', 'update', 'delete')")
def binlog_scan_allowed(spark, sf_dir):
    return normalize.admit(change_log(spark, sf_dir)).select("seq", "kind", "log_file", "log_pos")


@query(f"WITH {SIM} x AS (SELECT 1) SELECT seq FROM sim WHERE seq % 4 > 1")
def none_event_filter(spark, sf_dir):
    nth = F.col("seq") % 4  # events without a kind, and of a kind that no stream carries
    log = change_log(spark, sf_dir).withColumn("kind", F.when(nth == 1, "rotate").when(nth > 1, F.col("kind")))
    return normalize.admit(log).select("seq")


@query(f"WITH {SIM} x AS (SELECT 1) SELECT seq, kind, db, tbl FROM sim WHERE kind = 'query' OR tbl IN ('t1', 't1_data_pipeline_refresh', 't3', 't3_data_pipeline_refresh') OR db = 'heartbeat'")
def table_whitelist(spark, sf_dir):
    config = CONFIG.with_(table_whitelist=("t1", "t3", "t4_data_pipeline_refresh"))
    return normalize.whitelist(change_log(spark, sf_dir), config).select("seq", "kind", "db", "tbl")


@query(f"WITH {SIM} x AS (SELECT 1) SELECT seq FROM sim WHERE log_file > 'mysql-bin.000002' OR (log_file = 'mysql-bin.000002' AND log_pos >= 50004)")
def seek_log_position(spark, sf_dir):
    return positioning.seek(change_log(spark, sf_dir), "mysql-bin.000002", 50004).select("seq")


@query(f"WITH {SIM} x AS (SELECT 1) SELECT DISTINCT log_file FROM sim")
def list_log_files(spark, sf_dir):
    return positioning.log_files(change_log(spark, sf_dir))


@query(f"WITH {SIM} x AS (SELECT 1) SELECT log_file, log_pos FROM sim ORDER BY log_file DESC, log_pos DESC LIMIT 1")
def latest_position(spark, sf_dir):
    return positioning.latest_position(change_log(spark, sf_dir))


@query(f"WITH {SIM} x AS (SELECT 1) SELECT seq, log_file, log_pos FROM sim WHERE db = 'heartbeat' AND log_file >= 'mysql-bin.000002'")
def heartbeat_scan(spark, sf_dir):
    log = positioning.seek(change_log(spark, sf_dir), "mysql-bin.000002", 4)
    return log.where(F.col("db") == CONFIG.heartbeat_db).select("seq", "log_file", "log_pos")


# --- rows and images -----------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS row_idx, l_partkey, l_linenumber FROM lineitem")
def row_flatten(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    images = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    events = lines.groupBy("l_orderkey").agg(images.alias("rows")).withColumn("kind", F.lit("write"))
    flat = normalize.flatten_rows(events)
    return flat.select("l_orderkey", F.col("row_idx").cast("long").alias("row_idx"), "row.l_partkey", "row.l_linenumber")


@query(f"WITH {_POSITIONED} SELECT seq, message_type, base AS tbl FROM positioned")
def message_type(spark, sf_dir):
    log = change_log(spark, sf_dir).where(~positioning.is_marker(CONFIG))
    return normalize.with_message_type(log).select("seq", "message_type", "tbl")


@query(f"WITH {_POSITIONED} SELECT seq, base AS tbl FROM positioned WHERE message_type = 'refresh'")
def refresh_rewrite(spark, sf_dir):
    log = change_log(spark, sf_dir).where(~positioning.is_marker(CONFIG))
    return normalize.with_message_type(log).where("message_type = 'refresh'").select("seq", "tbl")


_IMAGES_SQL = """SELECT o_orderkey, o_totalprice AS new_price, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS old_price FROM orders"""


def _order_images(spark, sf_dir) -> DataFrame:
    """Orders as changes of their customer: the first is written, the others update."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    old = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    row = F.struct(
        F.when(F.col("old").isNull(), F.col("o_totalprice")).alias("values"),
        F.col("old").alias("before_values"),
        F.when(F.col("old").isNotNull(), F.col("o_totalprice")).alias("after_values"),
    )
    return orders.withColumn("old", old).withColumn("row", row).withColumn("kind", F.when(F.col("old").isNull(), "write").otherwise("update"))


@query(f"SELECT o_orderkey, new_price AS after_image FROM ({_IMAGES_SQL})")
def after_image(spark, sf_dir):
    return _order_images(spark, sf_dir).select("o_orderkey", normalize.after_image(F.col("row")).alias("after_image"))


@query(f"SELECT o_orderkey, old_price AS before_image FROM ({_IMAGES_SQL})")
def before_image(spark, sf_dir):
    return _order_images(spark, sf_dir).select("o_orderkey", normalize.before_image(F.col("row"), F.col("kind")).alias("before_image"))


# --- positions -----------------------------------------------------------------------------------------------------


@query(f"WITH {_POSITIONED} SELECT seq, kind, message_type, base AS tbl, pos_file, pos_log_pos, pos_offset, pos_serial, pos_time FROM positioned WHERE db <> 'mysql'")
def position_assign(spark, sf_dir):
    p = F.col("position")
    events = positioned(spark, sf_dir)
    kept = events.where(~filters.blacklisted(F.col("db"), CONFIG))
    return kept.select("seq", "kind", "message_type", "tbl", p["log_file"].alias("pos_file"), p["log_pos"].alias("pos_log_pos"), p["offset"].alias("pos_offset"), p["hb_serial"].alias("pos_serial"), p["hb_timestamp"].alias("pos_time"))


@query(
    f"""WITH {SIM} e AS (SELECT *, max(CASE WHEN seq % 5 = 0 THEN seq END) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS mark FROM sim)
SELECT seq, 'sid:' || (mark // 5 + 1)::VARCHAR AS gtid, row_number() OVER (PARTITION BY mark ORDER BY seq) - 2 AS pos_offset FROM e QUALIFY seq % 5 <> 0"""
)
def gtid_position_assign(spark, sf_dir):
    p = F.col("position")
    return positioned(spark, sf_dir, GTID_CONFIG).select("seq", p["gtid"].alias("gtid"), p["offset"].alias("pos_offset"))


_SAVED_FILE, _SAVED_OFFSET = "mysql-bin.000001", 2
_SAVED_MARK = "SELECT max(log_pos) FROM sim WHERE db = 'heartbeat' AND log_file = 'mysql-bin.000001'"


@query(
    f"""WITH {_POSITIONED} SELECT seq, pos_offset FROM positioned
WHERE (log_file > '{_SAVED_FILE}' OR log_pos >= ({_SAVED_MARK})) AND NOT (pos_file = '{_SAVED_FILE}' AND pos_log_pos = ({_SAVED_MARK}) AND pos_offset <= {_SAVED_OFFSET})"""
)
def resume_skip(spark, sf_dir):
    log = change_log(spark, sf_dir)
    marks = log.where(positioning.is_marker(CONFIG) & (F.col("log_file") == _SAVED_FILE))
    at = marks.agg(F.max("log_pos")).first()[0]
    saved = position.struct_of(log_file=F.lit(_SAVED_FILE), log_pos=F.lit(at), offset=F.lit(_SAVED_OFFSET))
    events = positioning.assign_positions(positioning.seek(log, _SAVED_FILE, at), CONFIG)
    return positioning.skip_to(events, saved, CONFIG).select("seq", F.col("position.offset").alias("pos_offset"))


@query(
    """SELECT event_id, 'sid:1-' || event_id::VARCHAR AS all_set, 'sid:1-' || (event_id + 1)::VARCHAR AS next_set,
CASE WHEN user_id % 3 = 0 THEN 'sid:1-' || (event_id + 1)::VARCHAR ELSE 'sid:1-' || event_id::VARCHAR END AS replay_set FROM events"""
)
def gtid_set_format(spark, sf_dir):
    gtid = F.concat(F.lit("sid:"), F.col("event_id").cast("string"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", position.gtid_set(gtid).alias("all_set"), position.next_gtid_set(gtid).alias("next_set"), position.replay_set(gtid, F.col("user_id") % 3).alias("replay_set"))


@query(
    f"""WITH {_POSITIONED} SELECT seq, CASE WHEN pos_file IS NULL THEN '{{"offset":' || pos_offset || '}}'
ELSE '{{"log_file":"' || pos_file || '","log_pos":' || pos_log_pos || ',"offset":' || pos_offset || CASE WHEN pos_serial <> 0 THEN ',"hb_serial":' || pos_serial || ',"hb_timestamp":' || pos_time ELSE '' END || '}}' END AS saved,
coalesce(pos_file, '') AS log_file FROM positioned"""
)
def position_codec(spark, sf_dir):
    events = positioned(spark, sf_dir).withColumn("saved", position.to_saved(F.col("position")))
    back = F.when(F.col("position.log_file").isNotNull(), position.from_saved(F.col("saved")))
    return events.select("seq", "saved", F.coalesce(back["log_file"], F.lit("")).alias("log_file"))


@query(
    f"""WITH {SIM} x AS (SELECT 1) SELECT seq, 'heartbeat serial: ' || seq || chr(10) || 'heartbeat timestamp: ' || (epoch_us(ts) // 1000000) || chr(10) || 'log file: ' || log_file || chr(10) || 'log position: ' || log_pos AS text
FROM sim WHERE db = 'heartbeat'"""
)
def position_text(spark, sf_dir):
    beats = heartbeat.heartbeats(change_log(spark, sf_dir), CONFIG)
    return beats.select("seq", position.printable(F.col("hb_serial"), F.col("hb_timestamp"), F.col("log_file"), F.col("log_pos")).alias("text"))


# --- filters -------------------------------------------------------------------------------------------------------


@query(f"WITH {SIM} x AS (SELECT 1) SELECT seq, db FROM sim WHERE db IS NULL OR db <> 'mysql'")
def schema_blacklist(spark, sf_dir):
    log = change_log(spark, sf_dir)
    return log.where(~filters.blacklisted(F.col("db"), CONFIG)).select("seq", "db")


@query(
    f"""WITH {SIM} q AS (SELECT seq, CASE WHEN seq % 3 = 0 THEN '' ELSE db END AS db,
  CASE seq % 4 WHEN 0 THEN 'ALTER TABLE mysql.user ADD c int' WHEN 1 THEN 'alter table `shop`.`t1` add c int' WHEN 2 THEN 'CREATE TABLE mysql.x (id int)' ELSE query END AS query
  FROM sim WHERE kind = 'query')
SELECT seq FROM q WHERE db <> 'mysql' AND NOT (seq % 4 IN (0, 2) AND db = '')"""
)
def late_blacklist_alter(spark, sf_dir):
    log = change_log(spark, sf_dir).where("kind = 'query'")
    nth = F.col("seq") % 4
    log = log.withColumn("db", F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("db"))).withColumn(
        "query", F.when(nth == 0, "ALTER TABLE mysql.user ADD c int").when(nth == 1, "alter table `shop`.`t1` add c int").when(nth == 2, "CREATE TABLE mysql.x (id int)").otherwise(F.col("query"))
    )
    return filters.drop_blacklisted(log, CONFIG).select("seq")


@query(f"WITH {SIM} x AS (SELECT 1) SELECT seq, db FROM sim WHERE db <> 'mysql'")
def reserved_databases(spark, sf_dir):
    log = change_log(spark, sf_dir).where(~filters.blacklisted(F.col("db"), CONFIG))
    return log.select("seq", filters.assert_not_reserved(F.col("db")).alias("db"))


@query(f"WITH {SIM} x AS (SELECT 1) SELECT seq, query FROM sim WHERE kind = 'query' AND query NOT IN ('BEGIN', 'COMMIT', 'USE shop')")
def skippable_queries(spark, sf_dir):
    return filters.schema_events(change_log(spark, sf_dir)).select("seq", "query")


def _statements(spark, sf_dir) -> DataFrame:
    """Statements of all kinds with names from the tables spliced in."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    k, name = F.col("p_partkey") % 11, F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    text = F.lit("DROP TRIGGER x")
    for i, (head, tail) in enumerate(_FORMS):
        text = F.when(k == i, F.concat(F.lit(head), name, F.lit(tail))).otherwise(text)
    return parts.select("p_partkey", text.alias("query"))


_FORMS = (
    ("CREATE TABLE IF NOT EXISTS `db1`.`", "` (id int) ENGINE=InnoDB"),
    ("alter table ", " add column rename_me int"),
    ("DROP TABLE IF EXISTS db2.", ", other"),
    ("CREATE DATABASE ", ""),
    ("drop schema ", ""),
    ("CREATE UNIQUE INDEX i ON ", " (id)"),
    ("DROP INDEX i ON ", ""),
    ("RENAME TABLE ", " TO y"),
    ("alter table `x` rename to ", ""),
    ("ALTER SCHEMA ", " CHARACTER SET utf8"),
)
_STATEMENTS_SQL = (
    "q AS (SELECT p_partkey, CASE p_partkey % 11 "
    + " ".join(f"WHEN {i} THEN '{head}' || 'p' || p_partkey || '{tail}'" for i, (head, tail) in enumerate(_FORMS))
    + " ELSE 'DROP TRIGGER x' END AS query FROM part)"
)


@query(f"WITH {_STATEMENTS_SQL} SELECT p_partkey, {_KIND_SQL} AS kind, p_partkey % 11 IN (7, 8) AS renames, p_partkey % 11 <> 10 AS supported FROM q")
def ddl_classify(spark, sf_dir):
    q = _statements(spark, sf_dir)
    kind = ddl.ddl_kind(F.col("query"))
    return q.select("p_partkey", kind.alias("kind"), ddl.ddl_renames(F.col("query")).alias("renames"), (kind != "unsupported").alias("supported"))


@query(
    f"""WITH {_STATEMENTS_SQL} SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 'db1' WHEN 2 THEN 'db2' END AS db,
CASE WHEN p_partkey % 11 IN (0, 1, 2) THEN 'p' || p_partkey WHEN p_partkey % 11 = 8 THEN 'x' END AS tbl FROM q"""
)
def ddl_table_name(spark, sf_dir):
    return _statements(spark, sf_dir).withColumn("t", ddl.ddl_target(F.col("query"))).select("p_partkey", "t.db", "t.tbl")


# --- types ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END AS iso FROM events")
def datetime_iso(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", types.datetime_to_iso(F.col("ts")).alias("iso"))


@query("SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))::BIGINT AS micros FROM events")
def time_micros(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    span = F.col("ts") - F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return e.select("event_id", types.time_to_micros(span).alias("micros"))


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds FROM orders")
def timestamp_utc(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", F.unix_timestamp(types.timestamp_to_utc(F.col("o_orderdate"))).alias("seconds"))


@query("SELECT p_partkey, array_to_string(list_sort(list_filter(string_split(replace(p_name, ' ', ','), ','), lambda x: x <> '')), ',') AS members FROM part")
def set_to_list(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.array_join(types.set_to_list(F.replace("p_name", F.lit(" "), F.lit(","))), ",").alias("members"))


_TYPES = ("int(11)", "set('a','b')", "timestamp", "datetime(6)", "time", "varchar(64)", "TIMESTAMP(6)", "text", "tinyint(1)", "year")


@query(
    "SELECT n_nationkey, t AS column_type FROM (SELECT n_nationkey, list_element(["
    + ", ".join("'" + t.replace("'", "''") + "'" for t in _TYPES)
    + "], (n_nationkey % 10 + 1)::INT) AS t FROM nation) WHERE regexp_matches(lower(t), '^(set|timestamp|datetime|time)')"
)
def type_map_filter(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    kinds = F.array(*[F.lit(t) for t in _TYPES])
    n = n.select("n_nationkey", F.create_map(F.lit("c"), F.get(kinds, F.col("n_nationkey") % 10)).alias("m"))
    return n.select("n_nationkey", F.explode(types.transform_map(F.col("m"))).alias("c", "column_type")).select("n_nationkey", "column_type")


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS epoch, (epoch(o_orderdate) // 86400)::BIGINT AS days, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 5 = 0 THEN 9223372036854775807 ELSE epoch(o_orderdate)::BIGINT // 86400 * 86400 END AS ends, true AS whole FROM orders")
def date_helpers(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    e = dates.to_epoch(F.col("o_orderdate"))
    return o.select(
        "o_orderkey", e.alias("epoch"), F.floor(dates.date_to_epoch(dates.epoch_to_date(e)) / 86400).alias("days"), F.date_format(dates.from_epoch(e), "yyyy-MM-dd").alias("day"),
        dates.date_to_epoch(F.when(F.col("o_orderkey") % 5 == 0, F.lit("9999-12-31").cast("date")).otherwise(dates.epoch_to_date(e))).alias("ends"), (F.unix_micros(dates.now_in_seconds()) % 1_000_000 == 0).alias("whole"),
    )


# --- messages ------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_POSITIONED} SELECT seq, message_type, db AS table_schema, base AS table_name, CASE WHEN kind <> 'delete' THEN user_id::INT END AS id, CASE WHEN message_type = 'update' THEN user_id::INT END AS previous_id
FROM positioned WHERE kind <> 'query' AND db <> 'mysql'"""
)
def changelog_message(spark, sf_dir):
    m = messages.data_messages(positioned(spark, sf_dir), CONFIG.with_(changelog_mode=True), keep=("seq",))
    p = F.from_json("payload_data", "table_schema string, table_name string, id int")
    b = F.from_json("previous_payload_data", "table_schema string, table_name string, id int")
    return m.select("seq", "message_type", p["table_schema"].alias("table_schema"), p["table_name"].alias("table_name"), p["id"].alias("id"), b["id"].alias("previous_id"))


@query(
    f"""WITH {SIM} e AS (SELECT *, max(CASE WHEN seq % 5 = 0 THEN seq END) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS mark FROM sim)
SELECT seq, 'source' AS cluster_name, 'sid:' || (mark // 5 + 1)::VARCHAR AS gtid FROM e WHERE seq % 5 <> 0"""
)
def global_transaction_id(spark, sf_dir):
    t = messages.transaction(GTID_CONFIG)
    return positioned(spark, sf_dir, GTID_CONFIG).select("seq", t["cluster_name"].alias("cluster_name"), t["gtid"].alias("gtid"))


@query("SELECT o_orderkey, 'main.source.shop.orders' AS topic, '{\"o_orderkey\":' || o_orderkey || '}' AS key FROM orders")
def topic_and_key(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    row = F.struct("o_orderkey", "o_custkey")
    return o.select("o_orderkey", messages.topic("main", "source", F.lit("shop"), F.lit("orders")).alias("topic"), messages.message_key(F.to_json(row), F.array(F.lit("o_orderkey"))).alias("key"))


@query("SELECT c_custkey, c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS has_pii FROM customer")
def pii_flag(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.lit("shop").alias("db"), F.col("c_nationkey").cast("string").alias("tbl"))
    listed = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey = 1").select(F.lit("shop").alias("db"), F.col("n_nationkey").cast("string").alias("tbl"))
    return messages.with_pii_flag(c, listed).select("c_custkey", "has_pii")


# --- schema history ------------------------------------------------------------------------------------------------

_VERSIONS_SQL = """v AS (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY seq) AS schema_id FROM (
  SELECT seq, log_file, log_pos, 'shop' AS db, 't' || (CASE WHEN starts_with(query, 'RENAME') THEN user_id + 1 ELSE user_id END) % 5 AS tbl,
    lower(split_part(query, ' ', 1)) || '_table' AS ddl_kind
  FROM sim WHERE kind = 'query' AND db = 'shop' AND query NOT IN ('BEGIN', 'USE shop')))"""
#: The columns of the five tables after each statement, as one text a table, carried from statement to statement.
_REPLAY_SQL = """ddl AS (SELECT seq, user_id % 5 AS u, left(query, 1) AS k, row_number() OVER (ORDER BY seq) AS n FROM sim
  WHERE kind = 'query' AND db = 'shop' AND query NOT IN ('BEGIN', 'USE shop')),
h(n, seq, tbl, s) AS (
  SELECT 0::BIGINT, -1::BIGINT, NULL::VARCHAR, [NULL, NULL, NULL, NULL, NULL]::VARCHAR[]
  UNION ALL
  SELECT d.n, d.seq, 't' || (CASE WHEN d.k = 'R' THEN d.u + 1 ELSE d.u END) % 5, list_transform([0, 1, 2, 3, 4], lambda i:
    CASE WHEN d.k = 'C' AND i = d.u THEN 'id int,value double,at datetime(6),tags set(''a'',''b''),took time(1)'
         WHEN d.k = 'A' AND i = d.u THEN coalesce(nullif(h.s[d.u + 1], '') || ',', '') || 'c' || d.seq || ' int'
         WHEN d.k = 'R' AND i = (d.u + 1) % 5 THEN coalesce(h.s[d.u + 1], '')
         WHEN d.k = 'R' AND i = d.u THEN NULL ELSE h.s[i + 1] END)
  FROM h JOIN ddl d ON d.n = h.n + 1),
defs AS (SELECT seq, 'shop' AS db, tbl, s[right(tbl, 1)::INT + 1] AS columns FROM h WHERE n > 0)"""


@query(f"WITH {SIM} {_VERSIONS_SQL} SELECT db, tbl, schema_id::INT AS schema_id, log_file AS from_file, log_pos AS from_pos, ddl_kind FROM v")
def schema_versions(spark, sf_dir):
    return catalog.schema_versions(change_log(spark, sf_dir), CONFIG).select("db", "tbl", "schema_id", "from_file", "from_pos", "ddl_kind")


@query(f"WITH RECURSIVE {SIM} {_REPLAY_SQL} SELECT seq, tbl, columns, strpos(columns, 'id int') > 0 AS has_key FROM defs")
def schema_columns(spark, sf_dir):
    log = change_log(spark, sf_dir)
    versions = catalog.schema_versions(log, CONFIG)
    at = log.where("kind = 'query'").select("seq", F.col("log_file").alias("from_file"), F.col("log_pos").alias("from_pos"))
    columns = F.array_join(F.transform(F.map_entries("column_types"), lambda e: F.concat(e["key"], F.lit(" "), e["value"])), ",")
    return versions.join(at, ["from_file", "from_pos"]).select("seq", "tbl", columns.alias("columns"), (F.size("primary_key") > 0).alias("has_key"))


@query(
    f"""WITH {_POSITIONED}, {_VERSIONS_SQL}
SELECT p.seq, p.base AS tbl, v.schema_id::INT AS schema_id
FROM positioned p ASOF LEFT JOIN v ON v.db = p.db AND v.tbl = p.base AND v.seq < p.seq WHERE p.kind <> 'query' AND p.db <> 'mysql'"""
)
def schema_asof_join(spark, sf_dir):
    versions = catalog.schema_versions(change_log(spark, sf_dir), CONFIG)
    rows = filters.data_events(filters.drop_blacklisted(positioned(spark, sf_dir), CONFIG))
    return catalog.with_schema_version(rows, versions).select("seq", "tbl", "schema_id")


_TYPED_AT = "strftime(p.ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(p.ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(p.ts, '%f') END"
_TOOK = "((p.seq % 30) * 3600 + (p.seq % 60) * 60 + 7) * 1000000 + 500000"


@query(
    f"""WITH RECURSIVE {_POSITIONED}, {_REPLAY_SQL},
t AS (SELECT p.*, coalesce(contains(d.columns, 'at datetime'), false) AS typed, coalesce(contains(d.columns, 'id int'), false) AS known
  FROM positioned p ASOF LEFT JOIN defs d ON d.db = p.db AND d.tbl = p.base AND d.seq < p.seq WHERE p.kind <> 'query' AND p.db <> 'mysql')
SELECT seq, CASE WHEN known THEN '{{"id":' || user_id || '}}' END AS keys,
  CASE WHEN kind <> 'delete' THEN CASE WHEN typed THEN {_TYPED_AT} ELSE strftime(p.ts, '%Y-%m-%d %H:%M:%S.%f') END END AS at,
  CASE WHEN kind <> 'delete' THEN CASE p.seq % 3 WHEN 0 THEN CASE WHEN typed THEN '[]' ELSE '' END WHEN 1 THEN CASE WHEN typed THEN '["a","b"]' ELSE 'b,a' END ELSE CASE WHEN typed THEN '["b"]' ELSE 'b' END END END AS tags,
  CASE WHEN message_type = 'update' THEN CASE WHEN typed THEN ((CASE WHEN p.seq % 4 = 0 THEN -1 ELSE 1 END) * ({_TOOK}))::VARCHAR
    ELSE (CASE WHEN p.seq % 4 = 0 THEN '-' ELSE '' END) || lpad((p.seq % 30)::VARCHAR, 2, '0') || ':' || lpad((p.seq % 60)::VARCHAR, 2, '0') || ':07.5' END END AS previous_took
FROM t p"""
)
def typed_payload(spark, sf_dir):
    versions = catalog.schema_versions(change_log(spark, sf_dir), CONFIG)
    m = messages.data_messages(positioned(spark, sf_dir), CONFIG, versions, keep=("seq",))
    part = lambda c, name: F.get_json_object(c, f"$.{name}")
    return m.select("seq", "keys", part("payload_data", "at").alias("at"), part("payload_data", "tags").alias("tags"), part("previous_payload_data", "took").alias("previous_took"))


@query(
    f"""WITH RECURSIVE {SIM} {_REPLAY_SQL},
made AS (SELECT d.*, s.query, row_number() OVER w AS schema_id, 'CREATE TABLE `' || d.tbl || '` (' || replace(regexp_replace(columns, '(^|,)([a-z0-9]+) ', '\\1`\\2` ', 'g'), ',`', ', `')
    || CASE WHEN contains(columns, 'id int') THEN ', PRIMARY KEY (`id`)' ELSE '' END || ')' AS new_statement
  FROM defs d JOIN sim s ON s.seq = d.seq WINDOW w AS (PARTITION BY d.tbl ORDER BY d.seq))
SELECT 'main.source.shop' AS namespace, tbl AS source, schema_id::INT AS schema_id, new_statement, CASE WHEN starts_with(query, 'ALTER') THEN query END AS alter_statement,
  CASE WHEN starts_with(query, 'ALTER') THEN lag(new_statement) OVER (PARTITION BY tbl ORDER BY seq) END AS old_statement FROM made"""
)
def schema_registration(spark, sf_dir):
    return catalog.register(catalog.schema_versions(change_log(spark, sf_dir), CONFIG), CONFIG)


@query(
    f"""WITH {_POSITIONED}, {_VERSIONS_SQL} SELECT p.seq, message_type, 'main.source.' || p.db || '.' || base AS topic, v.schema_id::INT AS schema_id,
CASE WHEN kind = 'delete' THEN NULL ELSE user_id END AS payload_id, CASE WHEN message_type = 'update' THEN user_id END AS previous_id, base IN ('t1', 't3') AS contains_pii,
pos_file AS up_file, pos_log_pos AS up_pos, pos_offset AS up_offset, 'source' AS cluster_name, p.db AS database_name, base AS table_name,
false AS dry_run, (epoch_us(ts) // 1000000) AS timestamp, pos_file AS meta_file, pos_log_pos AS meta_pos
FROM positioned p ASOF LEFT JOIN v ON v.db = p.db AND v.tbl = p.base AND v.seq < p.seq WHERE kind <> 'query' AND p.db <> 'mysql'"""
)
def message_envelope(spark, sf_dir):
    listed = spark.sql("SELECT 'shop' AS db, explode(array('t1', 't3')) AS tbl")
    m = messages.data_messages(positioned(spark, sf_dir), CONFIG, catalog.schema_versions(change_log(spark, sf_dir), CONFIG), keep=("seq",), pii=listed)
    up, p = F.col("upstream_position_info"), F.col("upstream_position_info.position")
    key = lambda c: F.get_json_object(c, "$.id").cast("long")
    return m.select(
        "seq", "message_type", "topic", "schema_id", key("payload_data").alias("payload_id"), key("previous_payload_data").alias("previous_id"), "contains_pii",
        p["log_file"].alias("up_file"), p["log_pos"].alias("up_pos"), p["offset"].alias("up_offset"), up["cluster_name"].alias("cluster_name"), up["database_name"].alias("database_name"),
        up["table_name"].alias("table_name"), "dry_run", "timestamp", F.col("meta")[0]["log_file"].alias("meta_file"), F.col("meta")[0]["log_pos"].alias("meta_pos"),
    )


#: A catalog of columns made from the parts: six databases, fifty tables in each.
_CATALOG_SQL = (
    "SELECT *, cast(row_number() OVER (PARTITION BY db, tbl ORDER BY p_partkey) AS int) AS ordinal_position FROM (SELECT p_partkey, "
    "CASE p_partkey % 6 WHEN 0 THEN 'mysql' WHEN 1 THEN 'test' ELSE concat('shop', cast(p_partkey % 6 AS varchar(20))) END AS db, "
    "concat('tbl_', cast(cast(floor(p_partkey / 6) AS bigint) % 50 AS varchar(20))) AS tbl, concat('c', cast(p_partkey AS varchar(20))) AS column_name, CASE p_partkey % 10 "
    + " ".join(f"WHEN {i} THEN '{t.replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(_TYPES))
    + " END AS column_type, CASE WHEN p_size % 4 = 0 THEN 'PRI' ELSE '' END AS column_key FROM part) parts"
)


def _catalog(spark, sf_dir) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    return spark.sql(_CATALOG_SQL)


@query(f"WITH c AS ({_CATALOG_SQL}) SELECT column_name, ordinal_position, column_type FROM c WHERE db = 'shop2' AND tbl = 'tbl_7'")
def catalog_columns(spark, sf_dir):
    return catalog.table_columns(_catalog(spark, sf_dir), "shop2", "tbl_7").select("column_name", "ordinal_position", "column_type")


@query(f"WITH c AS ({_CATALOG_SQL}) SELECT column_name, ordinal_position FROM c WHERE db = 'shop3' AND tbl = 'tbl_9' AND column_key = 'PRI'")
def primary_keys(spark, sf_dir):
    keys = _catalog(spark, sf_dir).where("column_key = 'PRI'").withColumn("constraint_name", F.lit("PRIMARY"))
    return catalog.primary_key(keys, "shop3", "tbl_9").select("column_name", "ordinal_position")


@query(f"WITH c AS ({_CATALOG_SQL}) SELECT db, tbl, count(*) AS columns, count(*) FILTER (WHERE regexp_matches(lower(column_type), '^(set|timestamp|datetime|time)')) AS transforms FROM c GROUP BY db, tbl")
def column_type_map(spark, sf_dir):
    columns = _catalog(spark, sf_dir)
    maps = catalog.column_types(columns).join(catalog.transformed_columns(columns), ["db", "tbl"])
    return maps.select("db", "tbl", F.size("column_types").cast("long").alias("columns"), F.size("transforms").cast("long").alias("transforms"))


@query(f"WITH c AS ({_CATALOG_SQL}) SELECT string_agg(db, ' ' ORDER BY db) AS databases FROM (SELECT DISTINCT db FROM c WHERE db <> 'mysql')")
def dump_db_list(spark, sf_dir):
    return filters.dump_databases(_catalog(spark, sf_dir), CONFIG)


@query(
    f"""WITH c AS ({_CATALOG_SQL}), w AS (SELECT 'shop' || (n_nationkey % 5 + 1) AS db, 'tbl_' || n_nationkey AS tbl FROM nation),
t AS (SELECT db, tbl, 'CREATE TABLE `' || tbl || '` (' || string_agg('`' || column_name || '` ' || column_type, ', ' ORDER BY ordinal_position)
  || coalesce(', PRIMARY KEY (' || string_agg('`' || column_name || '`', ', ' ORDER BY ordinal_position) FILTER (WHERE column_key = 'PRI') || ')', '') || ')' AS query FROM c GROUP BY db, tbl)
SELECT w.db, w.tbl, coalesce(t.query, '') AS query FROM w LEFT JOIN t ON t.db = w.db AND t.tbl = w.tbl"""
)
def show_create(spark, sf_dir):
    n = F.col("n_nationkey")
    wanted = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("shop"), (n % 5 + 1).cast("string")).alias("db"), F.concat(F.lit("tbl_"), n.cast("string")).alias("tbl"))
    return catalog.show_create(catalog.create_statements(_catalog(spark, sf_dir)), wanted)


@query(f"WITH c AS ({_CATALOG_SQL}) SELECT DISTINCT db, tbl FROM c WHERE tbl LIKE 'tbl_1%'")
def tables_like(spark, sf_dir):
    return catalog.tables_like(_catalog(spark, sf_dir), "tbl_1%")


# --- recovery and state --------------------------------------------------------------------------------------------

_RECOVER_FROM = 600
_RECOVERY_SQL = f"""{_POSITIONED},
part AS (SELECT * FROM positioned WHERE seq >= {_RECOVER_FROM} AND (kind <> 'query' OR query NOT LIKE 'ALTER%' OR seq > 900)),
ends AS (SELECT min(seq) FILTER (WHERE kind = 'query' AND query NOT IN ('BEGIN', 'COMMIT', 'USE shop')) AS ddl, min(seq) FILTER (WHERE kind <> 'query' AND pos_file = 'mysql-bin.000001' AND pos_log_pos >= 95004) AS caught FROM part)
SELECT seq FROM part, ends WHERE kind <> 'query' AND db <> 'mysql' AND seq < coalesce(ddl, 1000000000) AND seq <= coalesce(caught, 1000000000) ORDER BY seq LIMIT 40"""


@query(f"WITH {_RECOVERY_SQL}")
def recovery_window(spark, sf_dir):
    events = positioned(spark, sf_dir).where(F.col("seq") >= _RECOVER_FROM)
    events = events.where((F.col("kind") != "query") | ~F.col("query").startswith("ALTER") | (F.col("seq") > 900))
    config = CONFIG.with_(recovery_queue_size=40, producer_buffer_size=40)
    return recovery.recovery_window(events, config, recovery.caught_up("mysql-bin.000001", 95004)).select("seq")


@query(f"WITH {_POSITIONED} SELECT seq FROM positioned WHERE kind <> 'query' AND db <> 'mysql' AND seq % 3 <> 0")
def recovery_dedup(spark, sf_dir):
    replay = messages.data_messages(positioned(spark, sf_dir), CONFIG, keep=("seq",))
    return messages.unpublished(replay, replay.where(F.col("seq") % 3 == 0).select("topic", "seq"), ["topic", "seq"]).select("seq")


#: What is known of each table at the end of the log's first half (without t4), and at its end (without t0).
_HALVES_SQL = """half AS (SELECT (min(seq) + max(seq)) // 2 AS at FROM sim),
o AS (SELECT tbl, max(seq) AS v FROM sim, half WHERE seq <= half.at AND tbl <> 't4' GROUP BY tbl),
n AS (SELECT tbl, max(seq) + CASE WHEN tbl = 't2' THEN 7 ELSE 0 END AS v FROM sim WHERE tbl <> 't0' GROUP BY tbl)"""


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    log = change_log(spark, sf_dir).select("seq", "tbl")
    middle = log.agg(F.floor((F.min("seq") + F.max("seq")) / 2).alias("at")).first()["at"]
    seen = lambda rows, more: rows.groupBy("tbl").agg((F.max("seq") + more).alias("v"))
    more = F.when(F.col("tbl") == "t2", 7).otherwise(0)
    return seen(log.where((F.col("seq") <= middle) & (F.col("tbl") != "t4")), F.lit(0)), seen(log.where("tbl <> 't0'"), more)


@query(
    f"""WITH {SIM} {_HALVES_SQL}
SELECT coalesce(o.tbl, n.tbl) AS cluster_name, 'p' || coalesce(n.v, o.v) AS position, n.v IS NULL AS is_clean_shutdown, (CASE WHEN n.v IS NULL THEN 1 ELSE 2 END)::BIGINT AS time_updated FROM o FULL JOIN n ON o.tbl = n.tbl"""
)
def global_state_upsert(spark, sf_dir):
    old, new = _halves(spark, sf_dir)

    def states(reached: DataFrame, clean: bool, now: int) -> DataFrame:
        return reached.select(F.col("tbl").alias("cluster_name"), F.concat(F.lit("p"), F.col("v").cast("string")).alias("position"), F.lit(clean).alias("is_clean_shutdown"), F.lit(now).cast("long").alias("time_updated"))

    return state.upsert_global_state(states(old, True, 1), states(new, False, 2))


@query(
    f"""WITH {SIM} {_HALVES_SQL}
SELECT 'source' AS cluster_name, coalesce(o.tbl, n.tbl) AS topic, coalesce(n.v, o.v)::BIGINT AS topic_offset, (CASE WHEN o.v IS NULL THEN 2 ELSE 1 END)::BIGINT AS time_created,
(CASE WHEN n.v IS NULL OR n.v = o.v THEN 1 ELSE 2 END)::BIGINT AS time_updated FROM o FULL JOIN n ON o.tbl = n.tbl"""
)
def offset_upsert(spark, sf_dir):
    old, new = (x.select(F.lit("source").alias("cluster_name"), F.col("tbl").alias("topic"), F.col("v").cast("long").alias("topic_offset")) for x in _halves(spark, sf_dir))
    old = old.withColumn("time_created", F.lit(1).cast("long")).withColumn("time_updated", F.lit(1).cast("long"))
    return state.upsert_offsets(old, new, F.lit(2))


@query(f"WITH {SIM} x AS (SELECT 1) SELECT 'source' AS cluster_name, string_agg(tbl || '=' || v, ',' ORDER BY tbl) AS offsets FROM (SELECT tbl, max(log_pos) AS v FROM sim GROUP BY tbl)")
def offsets_map(spark, sf_dir):
    reached = change_log(spark, sf_dir).groupBy(F.lit("source").alias("cluster_name"), F.col("tbl").alias("topic")).agg(F.max("log_pos").cast("long").alias("topic_offset"))
    m = state.offsets_map(reached)
    pairs = F.transform(F.array_sort(F.map_entries("offsets")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("cluster_name", F.array_join(pairs, ",").alias("offsets"))


def _shared_folder(spark) -> str:
    """A folder of its own that the driver and all executors reach."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rowstream-")
    return f"{base}/catalogue-{uuid.uuid4().hex}"


_TABLE_STATE = "SELECT tbl, max(seq) AS last, count(*) AS n FROM sim"


@query(
    f"""WITH {SIM} half AS (SELECT (min(seq) + max(seq)) // 2 AS at FROM sim), o AS ({_TABLE_STATE}, half WHERE seq <= half.at GROUP BY tbl), n AS ({_TABLE_STATE} WHERE tbl <> 't3' GROUP BY tbl)
SELECT coalesce(n.tbl, o.tbl) AS cluster_name, coalesce(n.last, o.last)::VARCHAR AS position, coalesce(n.n, o.n)::BIGINT AS topic_offset, n.n IS NULL AS is_clean_shutdown FROM o FULL JOIN n ON o.tbl = n.tbl"""
)
def state_store(spark, sf_dir):
    """Two saves of state and offsets together, read back by cluster."""
    store = state.StateStore(spark, f"{_shared_folder(spark)}/state")
    log = change_log(spark, sf_dir)
    middle = log.agg(F.floor((F.min("seq") + F.max("seq")) / 2).alias("at")).first()["at"]
    for rows, clean, now in ((log.where(F.col("seq") <= middle), True, 1), (log.where("tbl <> 't3'"), False, 2)):
        reached = rows.groupBy("tbl").agg(F.max("seq").alias("last"), F.count("*").alias("n"))
        none = F.lit(None).cast("string")
        states = reached.select(F.col("tbl").alias("cluster_name"), F.col("last").cast("string").alias("position"), F.lit(clean).alias("is_clean_shutdown"), F.lit("data_event").alias("event_type"), none.alias("database_name"), none.alias("table_name"), F.lit(now).cast("long").alias("time_updated"))
        offsets = reached.select(F.col("tbl").alias("cluster_name"), F.lit("t").alias("topic"), F.col("n").alias("topic_offset"))
        store.save(global_state=state.upsert_global_state(store.read("global_state"), states), checkpoints=state.upsert_offsets(store.read("checkpoints"), offsets, F.lit(now)))
    both = store.read("global_state").join(store.read("checkpoints"), "cluster_name")
    return both.select("cluster_name", "position", "topic_offset", "is_clean_shutdown")


@query(f"WITH {SIM} x AS (SELECT 1) SELECT tbl AS topic, max(seq)::BIGINT AS topic_offset FROM sim GROUP BY tbl ORDER BY max(seq) DESC LIMIT 1")
def latest_checkpoint(spark, sf_dir):
    store = state.StateStore(spark, f"{_shared_folder(spark)}/state")
    reached = change_log(spark, sf_dir).groupBy("tbl").agg(F.max("seq").alias("last"))
    rows = reached.select(F.lit("source").alias("cluster_name"), F.col("tbl").alias("topic"), F.col("last").alias("topic_offset"), F.col("last").alias("time_created"), F.col("last").alias("time_updated"))
    store.save(checkpoints=rows)
    return state.last_created(store.read("checkpoints"), "source").select("topic", "topic_offset")


@query(
    f"""WITH c AS ({_CATALOG_SQL}) SELECT db, tbl, string_agg(column_name || ' ' || column_type, ',' ORDER BY column_name) AS columns,
coalesce(string_agg(column_name, ',' ORDER BY ordinal_position) FILTER (WHERE column_key = 'PRI'), '') AS keys FROM c WHERE db <> 'mysql' GROUP BY db, tbl"""
)
def schema_dump_restore(spark, sf_dir):
    """A catalog that was dumped, stored, replaced and restored."""
    store = state.StateStore(spark, f"{_shared_folder(spark)}/state")
    columns = _catalog(spark, sf_dir)
    keys = F.transform(F.array_sort(F.collect_list(F.when(F.col("column_key") == "PRI", F.struct("ordinal_position", "column_name")))), lambda k: k["column_name"])
    tables = catalog.column_types(columns).join(columns.groupBy("db", "tbl").agg(keys.alias("primary_key")), ["db", "tbl"])
    for rows in (tables.limit(3), tables.where("db <> 'mysql'")):
        dump = state.SchemaDump(store, "source")
        dump.create(rows)
        dump.persist()
    back = state.SchemaDump(store, "source").restore(BASE_TABLE)
    pairs = F.array_sort(F.transform(F.map_entries("column_types"), lambda e: F.concat(e["key"], F.lit(" "), e["value"])))
    return back.select("db", "tbl", F.array_join(pairs, ",").alias("columns"), F.array_join("primary_key", ",").alias("keys"))


@query("SELECT * FROM (VALUES ('clean', false, false, false), ('dumped', true, false, true), ('unclean', true, true, false), ('both', true, true, true), ('new', false, false, false)) t(cluster, need, replay, dump)")
def recovery_decision(spark, sf_dir):
    """Whether a cluster needs recovery, whether messages are replayed, and whether a dump is restored."""
    store = state.StateStore(spark, f"{_shared_folder(spark)}/state")
    for cluster, clean, dumped in (("clean", True, False), ("dumped", True, True), ("unclean", False, False), ("both", False, True)):
        store.save_position(cluster, '{"gtid":"sid:1"}', {}, 1, clean=clean)
        store.replace_dump(cluster, "{}")
        if not dumped:
            store.delete_dump(cluster)
    rows = [(c, recovery.need_recovery(store, c), recovery.replay_wanted(store, c), store.dump_exists(c)) for c in ("clean", "dumped", "unclean", "both", "new")]
    return spark.createDataFrame(rows, "cluster string, need boolean, replay boolean, dump boolean")


@query(
    f"""WITH {SIM} m AS (SELECT log_file, log_pos FROM sim WHERE db = 'heartbeat' ORDER BY seq DESC LIMIT 1)
SELECT 'resume' AS mode, '{{"log_file":"' || log_file || '","log_pos":' || log_pos || ',"offset":3}}' AS position FROM m UNION ALL VALUES ('begin', NULL), ('new', NULL)"""
)
def resume_position(spark, sf_dir):
    """Where to go on: the saved position, or the log's begin if resuming is off or nothing was saved."""
    store = state.StateStore(spark, f"{_shared_folder(spark)}/state")
    last = change_log(spark, sf_dir).where(positioning.is_marker(CONFIG)).agg(F.max(F.struct("log_file", "log_pos")).alias("at")).select("at.*")
    place = position.struct_of(log_file=F.col("log_file"), log_pos=F.col("log_pos"), offset=F.lit(3))
    store.save_position("source", last.select(position.to_saved(place).alias("p")).first()["p"], {}, 1)
    modes = {"resume": CONFIG, "begin": CONFIG.with_(resume_stream=False), "new": CONFIG.with_(cluster="other")}
    return spark.createDataFrame([(m, recovery.resume_position(store, c)) for m, c in modes.items()], "mode string, position string")


@query(f"WITH {_POSITIONED} SELECT 'main.source.' || db || '.' || base AS topic, count(*) AS messages, min(seq) AS first FROM positioned WHERE kind <> 'query' AND db <> 'mysql' GROUP BY 1")
def published_topics(spark, sf_dir):
    """Messages published to topic folders, of which one batch is published twice, and read back."""
    folder = f"{_shared_folder(spark)}/topics"
    sent = messages.data_messages(positioned(spark, sf_dir), CONFIG, keep=("seq",))
    for batch in (0, 1, 1):
        messages.write_topics(sent.where(F.col("seq") % 2 == batch), folder, batch)
    return spark.read.parquet(folder).groupBy("topic").agg(F.count("*").alias("messages"), F.min("seq").alias("first"))


def _raw(log: DataFrame) -> DataFrame:
    """The log as it is captured, with a row of images for each row event."""
    beat = F.to_json(F.struct(F.col("hb_serial").alias("serial"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp")))
    after = F.when(F.col("hb_serial").isNotNull(), beat).otherwise(F.col("after_image"))
    write = F.col("kind") == "write"
    row = F.struct(F.when(write, after).alias("values"), F.col("before_image").alias("before_values"), F.when(~write, after).alias("after_values"))
    rows = F.when(F.col("kind") != "query", F.array(row))
    parts = [F.col(f.name) if f.name in log.columns else F.lit("source").cast(f.dataType).alias(f.name) for f in RAW_EVENT.fields if f.name != "rows"]
    return log.select(*[p.cast(f.dataType).alias(f.name) for p, f in zip(parts, RAW_EVENT.fields, strict=False)], rows.alias("rows"))


_REPLAYED_SQL = f"""{_POSITIONED},
saved AS (SELECT ({_SAVED_MARK}) AS pos),
wanted AS (SELECT p.* FROM positioned p, saved WHERE kind <> 'query' AND db <> 'mysql' AND (log_file > '{_SAVED_FILE}' OR log_pos >= saved.pos)
  AND NOT (pos_file = '{_SAVED_FILE}' AND pos_log_pos = saved.pos AND pos_offset <= {_SAVED_OFFSET}) ORDER BY seq LIMIT 40)"""


@query(f"WITH {_REPLAYED_SQL} SELECT log_file, log_pos, 'main.source.' || db || '.' || base AS topic FROM wanted WHERE seq % 3 <> 0")
def restart_replay(spark, sf_dir):
    """After an unclean stop: of the recovery window behind the saved position, the messages that no topic holds yet."""
    log = change_log(spark, sf_dir)
    config = CONFIG.with_(recovery_queue_size=40, producer_buffer_size=40)
    # statements that name no table change stay, so that offsets count them, but end no window
    log = log.withColumn("query", F.when(F.col("kind") == "query", "BEGIN"))
    marks = log.where(positioning.is_marker(config) & (F.col("log_file") == _SAVED_FILE))
    at = marks.agg(F.max("log_pos")).first()[0]
    folder = _shared_folder(spark)
    store = state.StateStore(spark, f"{folder}/state")
    store.save_position("source", json.dumps({"log_file": _SAVED_FILE, "log_pos": at, "offset": _SAVED_OFFSET}), {}, 1, clean=False, db="shop", tbl="t1")
    raw = _raw(log)
    placed = positioning.assign_positions(prepared(raw, config), config)
    known = log.where("seq % 3 = 0").select("log_file", "log_pos")
    messages.write_topics(messages.data_messages(placed.join(known, ["log_file", "log_pos"], "left_semi"), config, keep=ORDER), f"{folder}/topics", 0, "before")
    stream = ChangeStream(spark, config, store, f"{folder}/topics")
    stream.resume()
    stream.recover(raw)
    return spark.read.parquet(f"{folder}/topics").where("run like 'recovery%'").select("log_file", F.col("log_pos").cast("long").alias("log_pos"), "topic")


# --- heartbeats and metrics ----------------------------------------------------------------------------------------


@query(f"WITH {SIM} b AS (SELECT * FROM sim WHERE db = 'heartbeat'), w AS (SELECT * FROM b WHERE seq = (SELECT min(seq) FROM b WHERE seq >= 700)) SELECT log_file, log_pos, seq AS hb_serial, (epoch_us(ts) // 1000000) AS hb_timestamp FROM w")
def heartbeat_search(spark, sf_dir):
    log = change_log(spark, sf_dir)
    wanted = heartbeat.heartbeats(log, CONFIG).where("seq >= 700").agg(F.min_by(F.struct("hb_timestamp", "hb_serial"), "seq").alias("w")).first()["w"]
    return heartbeat.search(log, CONFIG, wanted["hb_timestamp"], wanted["hb_serial"])


@query(f"WITH {SIM} x AS (SELECT 1) SELECT seq, 1800000000 - (epoch_us(ts) // 1000000) AS delay_seconds FROM sim WHERE db = 'heartbeat'")
def heartbeat_delay(spark, sf_dir):
    beats = heartbeat.heartbeats(change_log(spark, sf_dir), CONFIG)
    return heartbeat.with_delay(beats, F.lit(1800000000).cast("long")).select("seq", "delay_seconds")


@query(f"WITH {SIM} x AS (SELECT 1) SELECT tbl, count(*) AS events FROM sim WHERE kind <> 'query' GROUP BY tbl")
def table_event_counts(spark, sf_dir):
    return metrics.table_counts(change_log(spark, sf_dir))


@query(f"WITH {SIM} x AS (SELECT 1) SELECT query, count(*) AS events FROM sim WHERE kind = 'query' AND query NOT IN ('BEGIN', 'USE shop') GROUP BY query")
def ddl_event_counts(spark, sf_dir):
    return metrics.statement_counts(change_log(spark, sf_dir))


@query(f"WITH {SIM} x AS (SELECT 1) SELECT (epoch_us(ts) // 10000000) * 10 AS window_start, tbl, count(*) AS events FROM sim WHERE kind <> 'query' GROUP BY 1, 2")
def counts_10s_window(spark, sf_dir):
    w = metrics.windowed_counts(change_log(spark, sf_dir), CONFIG)
    return w.select(F.unix_timestamp("window.start").alias("window_start"), "tbl", "events")


_GAUGE_SQL = "g AS (SELECT (us // 2000000) * 2 AS window_start, max(seq % 1200) AS delay_seconds FROM (SELECT *, epoch_us(ts) AS us FROM sim) WHERE db = 'heartbeat' GROUP BY 1)"


@query(f"WITH {SIM} {_GAUGE_SQL} SELECT * FROM g")
def delay_gauge(spark, sf_dir):
    g = metrics.delay_gauge(heartbeat.heartbeats(change_log(spark, sf_dir), CONFIG), CONFIG, F.col("seq") % 1200)
    return g.select(F.unix_timestamp("window.start").alias("window_start"), "delay_seconds")


@query(f"WITH {SIM} {_GAUGE_SQL} SELECT * FROM g WHERE delay_seconds > 600")
def delay_alert(spark, sf_dir):
    return metrics.delay_alerts(delay_gauge(spark, sf_dir), CONFIG)
