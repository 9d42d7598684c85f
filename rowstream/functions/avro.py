"""Avro record schemas of tables, as a registry would hold them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from typing import Any

# Avro types of source types; what isn't listed is a string.
_TYPES = {
    "tinyint": "int",
    "smallint": "int",
    "mediumint": "int",
    "int": "int",
    "integer": "int",
    "bool": "int",
    "boolean": "int",
    "year": "int",
    "bigint": "long",
    "time": "long",
    "float": "float",
    "double": "double",
    "real": "double",
    "binary": "bytes",
    "varbinary": "bytes",
    "bit": "bytes",
}


def field(column: Mapping[str, Any], pkey: int | None = None) -> dict[str, Any]:
    """A column (column_name, column_type, is_nullable, column_default) as an Avro field. Columns that may be null are
    unions with null first; others keep their default; ``pkey`` is the column's place in the primary key."""
    text = column["column_type"].strip().lower()
    m = re.match(r"([a-z]+)\s*(?:\(([^)]*)\))?(.*)$", text)
    name, size, rest = m[1], m[2], m[3]
    kind: Any = "bytes" if name.endswith("blob") else _TYPES.get(name, "string")
    if name in ("int", "integer") and "unsigned" in rest:
        kind = "long"
    if name == "set":
        kind = {"type": "array", "items": "string"}
    out: dict[str, Any] = {"name": column["column_name"]}
    if column.get("is_nullable", "YES") == "YES" and pkey is None:
        out |= {"type": ["null", kind], "default": None}
    else:
        out["type"] = kind
        if column.get("column_default") is not None:
            out["default"] = column["column_default"]
    if size and name in ("char", "varchar", "nchar", "nvarchar"):
        out["maxlen"] = int(size)
    if size and name in ("float", "double", "decimal", "dec", "fixed", "numeric"):
        p, _, s = size.partition(",")
        out |= {"precision": int(p), "scale": int(s or 0)}
    if name in ("decimal", "dec", "fixed", "numeric"):
        out["decimal"] = True
    if pkey is not None:
        out["pkey"] = pkey
    return out


def record(namespace: str, table: str, columns: Iterable[Mapping[str, Any]], primary_key: Iterable[str] = ()) -> dict[str, Any]:
    """The record of a table; columns in ordinal order."""
    keys = list(primary_key)
    fields = [field(c, keys.index(c["column_name"]) + 1 if c["column_name"] in keys else None) for c in columns]
    out: dict[str, Any] = {"type": "record", "namespace": namespace, "name": table, "doc": f"Rows of {table}.", "fields": fields}
    return out | ({"pkey": keys} if keys else {})


def transaction_record(gtid: bool) -> dict[str, Any]:
    """The record of a transaction's id."""
    parts = [("gtid", "string")] if gtid else [("log_file", "string"), ("log_pos", "long")]
    return {"type": "record", "name": "global_transaction_id" if gtid else "log_transaction_id", "fields": [{"name": n, "type": t} for n, t in [("cluster_name", "string"), *parts]]}


def changelog_record() -> dict[str, Any]:
    return {"type": "record", "name": "changelog", "fields": [{"name": "table_schema", "type": "string"}, {"name": "table_name", "type": "string"}, {"name": "id", "type": "int"}]}


def load(path: str) -> dict[str, Any]:
    """A record from a file, JSON or YAML; it must have a name and fields."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict) or found.get("type") != "record" or not found.get("name") or not isinstance(found.get("fields"), list):
        raise ValueError(f"{path} holds no record")
    return found
