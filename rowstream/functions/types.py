"""Source column types: their Spark types, and the form their values take in messages."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type name prefixes whose values are transformed.
TRANSFORMED = ("set", "timestamp", "datetime", "time")

# Spark types of source types, without and with UNSIGNED.
_SIMPLE = {
    "tinyint": ("smallint", "smallint"),
    "bool": ("smallint", "smallint"),
    "boolean": ("smallint", "smallint"),
    "smallint": ("int", "int"),
    "mediumint": ("int", "int"),
    "int": ("int", "bigint"),
    "integer": ("int", "bigint"),
    "bigint": ("bigint", "decimal(20,0)"),
    "float": ("float", "float"),
    "double": ("double", "double"),
    "real": ("double", "double"),
    "date": ("date", "date"),
    "datetime": ("timestamp_ntz", "timestamp_ntz"),
    "timestamp": ("timestamp_ntz", "timestamp_ntz"),
    "time": ("interval day to second", "interval day to second"),
    "year": ("int", "int"),
    "bit": ("binary", "binary"),
    "binary": ("binary", "binary"),
    "varbinary": ("binary", "binary"),
}


def spark_type(source_type: str) -> str:
    """The Spark type of a column type such as ``decimal(10,2) unsigned``."""
    text = source_type.strip().lower()
    m = re.match(r"([a-z]+)\s*(?:\(([^)]*)\))?(.*)$", text)
    if not m:
        raise ValueError(f"not a column type: {source_type!r}")
    name, size, rest = m[1], m[2], m[3]
    if name in ("decimal", "dec", "fixed", "numeric"):
        p, _, s = (size or "10,0").partition(",")
        return f"decimal({int(p)},{int(s or 0)})"
    if name == "float" and size and "," not in size and int(size) > 24:
        return "double"
    if name.endswith("blob"):
        return "binary"
    if name == "set":
        return "array<string>"
    if name in _SIMPLE:
        return _SIMPLE[name]["unsigned" in rest]
    return "string"


def is_transformed(source_type: Column) -> Column:
    return F.lower(source_type).rlike(f"^({'|'.join(TRANSFORMED)})")


def transform_map(column_types: Column) -> Column:
    """Of a map from column to type, the entries whose values are transformed."""
    return F.map_filter(column_types, lambda _, v: is_transformed(v))


def set_to_list(value: Column) -> Column:
    """Members of a set, in order; an empty set has none."""
    return F.array_sort(F.filter(F.split(value, ","), lambda x: x != ""))


def timestamp_to_utc(value: Column) -> Column:
    """The naive time is taken to be UTC; the session's zone is UTC."""
    return value.cast("timestamp")


def datetime_to_iso(value: Column) -> Column:
    """ISO 8601; six digits of a second where there are any."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(value, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def time_to_micros(value: Column) -> Column:
    """Microseconds of an interval, which may be negative or longer than a day."""
    return F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + value)


def transformed(value: Column, source_type: str) -> Column:
    """The message form of a value; null stays null."""
    kind = source_type.strip().lower()
    if kind.startswith("set"):
        return set_to_list(value)
    if kind.startswith("timestamp"):
        return timestamp_to_utc(value)
    if kind.startswith("datetime"):
        return datetime_to_iso(value)
    if kind.startswith("time"):
        return time_to_micros(value)
    return value


def project(image: Column, column_types: Mapping[str, str]) -> Column:
    """An image with every column in its message form, in the table's order."""
    return F.struct(*[transformed(image[name], kind).alias(name) for name, kind in column_types.items()])


# --- images as JSON ------------------------------------------------------------------------------------------------


def time_text_to_micros(text: Column) -> Column:
    """Microseconds of a time such as -101:02:03.5; null if it is none."""
    form = r"^(-?)(\d+):(\d{1,2}):(\d{1,2})(?:\.(\d{1,6}))?$"
    part = lambda i: F.regexp_extract(text, form, i)
    whole = (part(2).cast("long") * 3600 + part(3).cast("long") * 60 + part(4).cast("long")) * 1_000_000
    micros = whole + F.rpad(part(5), 6, "0").cast("long")
    return F.when(text.rlike(form), F.when(part(1) == "-", -micros).otherwise(micros))


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def transformed_json(value: Column, source_type: Column) -> Column:
    """The message form, as JSON, of a JSON value (a variant) of a column of that type: members of a set as a list,
    timestamps in UTC and datetimes in ISO 8601, times in microseconds. Other values, and those that can't be read as
    their type, stay as they are."""
    text, kind = value.cast("string"), F.lower(source_type)
    moment = text.try_cast("timestamp_ntz")
    iso = datetime_to_iso(moment)
    return F.coalesce(
        F.when(value.isNull() | text.isNull(), F.lit("null"))
        .when(kind.startswith("set"), F.to_json(set_to_list(text)))
        .when(kind.startswith("timestamp"), _quoted(F.concat(iso, F.lit("+00:00"))))
        .when(kind.startswith("datetime"), _quoted(iso))
        .when(kind.startswith("time"), time_text_to_micros(text).cast("string")),
        F.to_json(value),
    )


def project_json(image: Column, column_types: Column) -> Column:
    """An image (a JSON object) with every value in its message form; columns that the types don't know stay as they are."""
    values = F.map_entries(F.from_json(image, "map<string,variant>"))
    pairs = F.transform(values, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), transformed_json(e["value"], F.element_at(column_types, e["key"]))))
    return F.when(column_types.isNull(), image).otherwise(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))
