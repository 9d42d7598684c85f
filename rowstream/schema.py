"""Row types of the engine."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, MapType, StringType, StructType

_KINDS = {"string": StringType(), "long": LongType(), "int": IntegerType(), "boolean": BooleanType()}


def _struct(text: str, **more: DataType) -> StructType:
    """A struct from ``name kind, ...``; needs no running session."""
    out = StructType()
    for name, kind in (part.split() for part in text.split(",")):
        out = out.add(name, _KINDS[kind])
    for name, kind in more.items():
        out = out.add(name, kind)
    return out


#: A captured log event. ``rows`` holds the images of a row event as JSON.
RAW_EVENT = _struct(
    "kind string, cluster string, db string, tbl string, log_file string, log_pos long, gtid string, ts_epoch long, query string",
    rows=ArrayType(_struct("values string, before_values string, after_values string")),
)
POSITION = _struct("gtid string, log_file string, log_pos long, offset long, hb_serial long, hb_timestamp long")
CHANGELOG_PAYLOAD = _struct("table_schema string, table_name string, id int")
GLOBAL_STATE = _struct("cluster_name string, position string, is_clean_shutdown boolean, event_type string, database_name string, table_name string, time_updated long")
CHECKPOINT = _struct("cluster_name string, topic string, topic_offset long, time_created long, time_updated long")
STATEMENT = _struct("cluster_name string, kind string, db string, log_file string, log_pos long, query string")
SCHEMA_DUMP = _struct("cluster_name string, database_dump string")
CATALOG_COLUMN = _struct(
    "db string, tbl string, column_name string, ordinal_position int, column_default string, is_nullable string, data_type string, "
    "character_maximum_length long, numeric_precision long, numeric_scale long, column_type string, column_key string"
)
CATALOG_KEY = _struct("db string, tbl string, constraint_name string, column_name string, ordinal_position int")
#: The tables that a log begins with.
BASE_TABLE = _struct("db string, tbl string", column_types=MapType(StringType(), StringType()), primary_key=ArrayType(StringType()))

#: What puts events in order; Spark keeps none by itself.
ORDER = ("log_file", "log_pos", "row_idx")
