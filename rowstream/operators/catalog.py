"""Schema history: versions of tables by position, and the lookups a tracker database answers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowstream.config import StreamConfig
from rowstream.functions.ddl import ddl_renames
from rowstream.functions.replay import Table, apply
from rowstream.functions.types import is_transformed, transform_map
from rowstream.operators.filters import drop_blacklisted, resolved_db, schema_events


def table_columns(columns: DataFrame, db: str, tbl: str) -> DataFrame:
    """A table's columns in order; the filter reaches the scan."""
    return columns.where((F.col("db") == db) & (F.col("tbl") == tbl)).orderBy("ordinal_position")


def primary_key(keys: DataFrame, db: str, tbl: str) -> DataFrame:
    return keys.where((F.col("db") == db) & (F.col("tbl") == tbl) & (F.col("constraint_name") == "PRIMARY")).orderBy("ordinal_position")


def tables_like(catalog: DataFrame, pattern: str) -> DataFrame:
    """Tables whose name is like ``pattern``, wildcards and all."""
    return catalog.select("db", "tbl").distinct().where(F.col("tbl").like(pattern))


def table_exists(catalog: DataFrame, db: str, tbl: str) -> bool:
    return not catalog.where((F.col("db") == db) & (F.col("tbl") == tbl)).limit(1).isEmpty()


def create_statement(tbl: Column, column_types: Column, primary_key: Column) -> Column:
    """The statement that makes a table, with its columns in the map's order; null for a table that is gone."""
    quoted = lambda name: F.concat(F.lit("`"), name, F.lit("`"))
    entries = F.transform(F.map_entries(column_types), lambda e: F.concat(quoted(e["key"]), F.lit(" "), e["value"]))
    key = F.concat(F.lit("PRIMARY KEY ("), F.array_join(F.transform(primary_key, quoted), ", "), F.lit(")"))
    parts = F.when(F.size(primary_key) > 0, F.concat(entries, F.array(key))).otherwise(entries)
    return F.concat(F.lit("CREATE TABLE "), quoted(tbl), F.lit(" ("), F.array_join(parts, ", "), F.lit(")"))


def create_statements(columns: DataFrame) -> DataFrame:
    """db, tbl and the statement that makes the table."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name", "column_type", "column_key")))
    tables = columns.groupBy("db", "tbl").agg(ordered.alias("cols"))
    types = F.map_from_entries(F.transform("cols", lambda c: F.struct(c["column_name"], c["column_type"])))
    key = F.transform(F.filter("cols", lambda c: c["column_key"] == "PRI"), lambda c: c["column_name"])
    return tables.select("db", "tbl", create_statement(F.col("tbl"), types, key).alias("query"))


def show_create(tables: DataFrame, wanted: DataFrame) -> DataFrame:
    """The statement of each wanted table (db, tbl); empty where there is none. ``tables``: db, tbl, query."""
    return wanted.join(tables.select("db", "tbl", "query"), ["db", "tbl"], "left").withColumn("query", F.coalesce("query", F.lit("")))


def column_types(columns: DataFrame) -> DataFrame:
    """db, tbl and the map from column to type."""
    pairs = F.array_sort(F.collect_list(F.struct("column_name", "column_type")))
    return columns.groupBy("db", "tbl").agg(F.map_from_entries(pairs).alias("column_types"))


def transformed_columns(columns: DataFrame) -> DataFrame:
    """db, tbl and the map of those columns whose values messages hold in another form."""
    return column_types(columns).withColumn("transforms", transform_map(F.col("column_types"))).drop("column_types")


def transformed_list(columns: DataFrame) -> DataFrame:
    return columns.where(is_transformed(F.col("column_type")))


def table_metadata(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """db, tbl, columns and primary keys as arrays in ordinal order."""
    rest = [c for c in columns.columns if c not in ("db", "tbl", "ordinal_position")]
    cols = columns.groupBy("db", "tbl").agg(F.array_sort(F.collect_list(F.struct("ordinal_position", *rest))).alias("columns"))
    primary = keys.where("constraint_name = 'PRIMARY'").groupBy("db", "tbl").agg(F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name"))).alias("primary_keys"))
    return cols.join(primary, ["db", "tbl"], "left")


def schema_versions(events: DataFrame, config: StreamConfig, base: DataFrame | None = None) -> DataFrame:
    """A version for each table that a statement makes, changes, renames or drops: db, tbl, schema_id, from_file,
    from_pos, ddl_kind, renames, query, column_types (in order; null once dropped) and primary_key.

    Statements are carried out in log order on the tables of ``base`` (db, tbl, column_types, primary_key), which are
    their first versions. Versions hold from their place in the log on, so none is ever stale; a table that is renamed
    gives its columns to a version of the new name. Ids are dense by table. Renames link tables, so the statements (not
    the row events) go through one task, which holds the present tables only.
    """
    ddl = schema_events(drop_blacklisted(events, config))
    names = "db string, tbl string, log_file string, log_pos long, ddl_kind string, query string, column_types map<string,string>, primary_key array<string>"
    rows = ddl.select(
        resolved_db(F.col("db"), F.col("query")).alias("db"), F.lit(None).cast("string").alias("tbl"), "log_file", F.col("log_pos").cast("long").alias("log_pos"), "ddl_kind", "query",
        F.lit(None).cast("map<string,string>").alias("column_types"), F.lit(None).cast("array<string>").alias("primary_key"), ddl_renames(F.col("query")).alias("renames"),
    )
    if base is not None:
        first = base.select("db", "tbl", F.lit("").alias("log_file"), F.lit(-1).cast("long").alias("log_pos"), F.lit("base").alias("ddl_kind"), F.lit(None).cast("string").alias("query"), "column_types", "primary_key", F.lit(False).alias("renames"))
        rows = first.unionByName(rows)
    schema = names.replace("log_file", "from_file").replace("log_pos", "from_pos") + ", schema_id int, renames boolean"
    ordered = rows.repartition(1).sortWithinPartitions("log_file", "log_pos", "db", "tbl")
    made = ordered.mapInArrow(_replay, schema).select("db", "tbl", "schema_id", "from_file", "from_pos", "ddl_kind", "renames", "query", "column_types", "primary_key")
    return made.repartition("db", "tbl")  # an exchange that plans which read versions twice can share


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[tuple[str, str], Table] = {}
    ids: dict[tuple[str, str], int] = {}
    schema = pa.schema([
        ("db", pa.string()), ("tbl", pa.string()), ("from_file", pa.string()), ("from_pos", pa.int64()), ("ddl_kind", pa.string()), ("query", pa.string()),
        ("column_types", pa.map_(pa.string(), pa.string())), ("primary_key", pa.list_(pa.string())), ("schema_id", pa.int32()), ("renames", pa.bool_()),
    ])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["query"] is None:
                name = (r["db"], r["tbl"])
                tables[name] = Table(dict(r["column_types"] or []), list(r["primary_key"] or []))
                changed = [name]
            else:
                changed = apply(tables, r["db"], r["query"])
            for name in changed:
                ids[name] = ids.get(name, 0) + 1
                table = tables.get(name)
                out.append((*name, r["log_file"], r["log_pos"], r["ddl_kind"], r["query"], list(table.columns.items()) if table else None, table.key if table else None, ids[name], r["renames"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def with_schema_version(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Each event with the last version of its table before it; null before the first.

    Versions and events of a table stand in one order within a log file, and each event takes the last version seen; so
    a busy table's events aren't one task. What a table has reached before a file is one row per table and file, counted
    before any shuffle, and joined by equal keys.
    """
    key = ["db", "tbl", "log_file"]
    both = events.withColumn("__v", F.lit(None).cast("int")).unionByName(
        versions.select("db", "tbl", F.col("from_file").alias("log_file"), F.col("from_pos").alias("log_pos"), F.lit(-1).alias("row_idx"), F.col("schema_id").alias("__v"), F.lit(True).alias("__is")),
        allowMissingColumns=True,
    )
    within = Window.partitionBy(*key).orderBy("log_pos", "row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("__seen", F.last("__v", ignorenulls=True).over(within))
    # ids rise along the log, so a file's greatest is its last
    ends = both.groupBy(*key).agg(F.max("__v").alias("__end"))
    before = Window.partitionBy("db", "tbl").orderBy("log_file").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__came", F.max("__end").over(before)).where("__came is not null")
    carried = carried.select(*[F.col(c).alias(f"__{c}") for c in key], "__came")
    same = (F.col("db") == F.col("__db")) & (F.col("tbl") == F.col("__tbl")) & (F.col("log_file") == F.col("__log_file"))
    rows = seen.where(F.col("__is").isNull()).join(carried, same, "left")
    return rows.withColumn("schema_id", F.coalesce("__seen", "__came")).drop("__v", "__is", "__seen", "__db", "__tbl", "__log_file", "__came")


def with_definition(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Events with a version (``schema_id``), and that version's column_types and primary_key."""
    return events.join(versions.select("db", "tbl", "schema_id", "column_types", "primary_key"), ["db", "tbl", "schema_id"], "left")


def register(versions: DataFrame, config: StreamConfig) -> DataFrame:
    """Registry entries: namespace, source, schema id and the statement that makes the table; for an ALTER also that
    statement and the one that made the table before. A dry run gives every table the id 1."""
    previous = Window.partitionBy("db", "tbl").orderBy("from_file", "from_pos")
    made = versions.withColumn("new_statement", create_statement(F.col("tbl"), F.col("column_types"), F.col("primary_key")))
    alters = F.col("ddl_kind") == "alter_table"
    return made.select(
        F.concat_ws(".", F.lit(config.environment), F.lit(config.logical_cluster), "db").alias("namespace"),
        F.col("tbl").alias("source"),
        (F.lit(1) if config.register_dry_run else F.col("schema_id")).alias("schema_id"),
        "new_statement",
        F.when(alters, F.lag("new_statement").over(previous)).alias("old_statement"),
        F.when(alters, F.col("query")).alias("alter_statement"),
    )
