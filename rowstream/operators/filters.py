"""What handlers leave out. Apply these after positions are assigned: events that they drop count in offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowstream.config import RESERVED_DATABASES, SKIPPED_QUERIES, StreamConfig
from rowstream.functions.ddl import ddl_kind, ddl_target
from rowstream.operators.normalize import is_row


def blacklisted(db: Column, config: StreamConfig) -> Column:
    """Never null: an event without a database isn't listed."""
    return F.coalesce(db.isin(*config.schema_blacklist), F.lit(False)) if config.schema_blacklist else F.lit(False)


def resolved_db(db: Column, query: Column) -> Column:
    """The event's database, or the statement's if that is blank."""
    return F.coalesce(F.when(F.trim(db) != "", db), ddl_target(query)["db"])


def drop_blacklisted(events: DataFrame, config: StreamConfig) -> DataFrame:
    """By the event's database; table statements also by the database they name (with ``strict_parity``, ALTER only)."""
    kind = ddl_kind(F.col("query"))
    late = (kind == "alter_table") if config.strict_parity else kind.isin("alter_table", "create_table", "drop_table")
    named = F.coalesce(late, F.lit(False)) & blacklisted(resolved_db(F.col("db"), F.col("query")), config)
    return events.where(~blacklisted(F.col("db"), config) & ~named)


def skippable(query: Column) -> Column:
    """Transaction brackets, exactly as written, and statements of no supported kind."""
    return query.isin(*SKIPPED_QUERIES) | (ddl_kind(query) == "unsupported")


def schema_events(events: DataFrame) -> DataFrame:
    """Supported statements, with their kind and target."""
    found = events.where((F.col("kind") == "query") & F.col("query").isNotNull() & ~skippable(F.col("query")))
    return found.withColumn("ddl_kind", ddl_kind(F.col("query"))).withColumn("target", ddl_target(F.col("query")))


def data_events(events: DataFrame) -> DataFrame:
    return events.where(is_row())


def assert_not_reserved(db: Column) -> Column:
    """The database, or an error if it is one of the server's own."""
    return F.when(F.lower(db).isin(*RESERVED_DATABASES), F.raise_error(F.concat(F.lit("reserved database: "), db))).otherwise(db)


def dump_databases(databases: DataFrame, config: StreamConfig, column: str = "db") -> DataFrame:
    """One row: the databases to dump, in order, with blanks between them."""
    kept = databases.select(column).distinct().where(~blacklisted(F.col(column), config))
    return kept.agg(F.concat_ws(" ", F.array_sort(F.collect_list(column))).alias("databases"))
