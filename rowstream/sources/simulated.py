"""A change log made from a table of events, for tests, benchmarks and examples.

``LOG_SQL`` runs alike on Spark and other engines: a log file holds 1000 events; errors are heartbeats, views are
statements, the other kinds are row events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SQL = """
SELECT event_id AS seq,
  concat('mysql-bin.', lpad(cast(cast(floor(event_id / 1000) AS bigint) + 1 AS varchar(20)), 6, '0')) AS log_file,
  4 + (event_id % 1000) * 100 AS log_pos, ts,
  CASE event_type WHEN 'error' THEN 'update' WHEN 'signup' THEN 'write' WHEN 'purchase' THEN 'delete'
                  WHEN 'view' THEN 'query' ELSE 'update' END AS kind,
  CASE WHEN event_type = 'error' THEN 'heartbeat' WHEN user_id % 10 = 0 THEN 'mysql' ELSE 'shop' END AS db,
  CASE WHEN event_type = 'error' THEN 'replication_heartbeat'
       WHEN event_id % 7 = 0 THEN concat('t', cast(user_id % 5 AS varchar(20)), '_data_pipeline_refresh')
       ELSE concat('t', cast(user_id % 5 AS varchar(20))) END AS tbl,
  CASE WHEN event_type = 'view' THEN CASE event_id % 5 WHEN 0 THEN 'BEGIN'
       WHEN 1 THEN concat('ALTER TABLE `t', cast(user_id % 5 AS varchar(20)), '` ADD c', cast(event_id AS varchar(20)), ' int')
       WHEN 2 THEN concat('RENAME TABLE `t', cast(user_id % 5 AS varchar(20)), '` TO `t', cast((user_id + 1) % 5 AS varchar(20)), '`')
       WHEN 3 THEN concat('CREATE TABLE `t', cast(user_id % 5 AS varchar(20)), '` (id int, value double, at datetime(6), tags set(''a'',''b''), took time(1), PRIMARY KEY (id))')
       ELSE 'USE shop' END END AS query,
  CASE WHEN event_type = 'error' THEN event_id END AS hb_serial,
  user_id, value
FROM events
"""


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with one row for each event, ready for the operators: ``gtid``, ``row_idx``, heartbeat time and images added."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    log = spark.sql(LOG_SQL)
    row = F.col("kind") != "query"
    two = lambda n: F.lpad((F.col("seq") % n).cast("string"), 2, "0")
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")
    tags = F.element_at(F.array(F.lit(""), F.lit("b,a"), F.lit("b")), (F.col("seq") % 3 + 1).cast("int")).alias("tags")
    took = F.concat(F.when(F.col("seq") % 4 == 0, "-").otherwise(""), two(30), F.lit(":"), two(60), F.lit(":07.5")).alias("took")
    image = lambda value: F.to_json(F.struct(F.col("user_id").alias("id"), value.alias("value"), at, tags, took))
    return (
        log.withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("ts_epoch", F.unix_timestamp("ts"))
        .withColumn("hb_timestamp", F.when(F.col("hb_serial").isNotNull(), F.unix_timestamp("ts")))
        .withColumn("gtid", F.lit(None).cast("string"))
        .withColumn("row_idx", F.lit(0))
        .withColumn("after_image", F.when(row & (F.col("kind") != "delete"), image(F.col("value"))))
        .withColumn("before_image", F.when(F.col("kind").isin("update", "delete"), image(F.lit(0.0))))
    )


def gtid_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log with every fifth event turned into the marker of a transaction."""
    marker = F.col("seq") % 5 == 0
    return (
        change_log(spark, sf_dir)
        .withColumn("kind", F.when(marker, "gtid").otherwise(F.col("kind")))
        .withColumn("gtid", F.when(marker, F.concat(F.lit("sid:"), (F.floor(F.col("seq") / 5) + 1).cast("string"))))
    )
