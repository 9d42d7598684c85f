"""Settings of a change stream, in one frozen record."""

from __future__ import annotations

import os
import secrets
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

# Names and limits that change streams are exchanged with.
REFRESH_SUFFIX = "_data_pipeline_refresh"
RESERVED_DATABASES = ("information_schema", "mysql", "performance_schema")
SKIPPED_QUERIES = ("BEGIN", "COMMIT")
ROW_KINDS = ("write", "update", "delete")
ADMITTED_KINDS = ("gtid", "query", "write", "update", "delete")


@dataclass(frozen=True)
class StreamConfig:
    """``strict_parity`` keeps the narrow blacklist rule for statements other than ALTER."""

    cluster: str = "source"
    environment: str = "main"
    schema_blacklist: tuple[str, ...] = ("information_schema", "mysql", "performance_schema", "test")
    table_whitelist: tuple[str, ...] = ()
    heartbeat_db: str = "heartbeat"
    gtid_enabled: bool = False
    resume_stream: bool = True
    changelog_mode: bool = False
    publish_dry_run: bool = False
    register_dry_run: bool = False
    strict_parity: bool = False
    topology_name: str | None = None
    recovery_queue_size: int = 1500
    producer_buffer_size: int = 500
    max_delay_seconds: int = 600
    counter_window_seconds: int = 10
    gauge_window_seconds: int = 2

    def __post_init__(self) -> None:
        if self.producer_buffer_size > self.recovery_queue_size:
            raise ValueError("what the producer buffers must fit in the recovery queue")

    @property
    def logical_cluster(self) -> str:
        """The name that messages carry: the topology's, if the source is re-parented."""
        return self.topology_name or self.cluster

    @classmethod
    def layered(cls, *layers: Mapping[str, Any], env: Mapping[str, str] | None = None, prefix: str = "ROWSTREAM_") -> StreamConfig:
        """Later layers win; environment variables win over all. Unknown names are an error."""
        known = {f.name: f for f in fields(cls)}
        merged: dict[str, Any] = {}
        for layer in layers:
            for name, value in layer.items():
                if name not in known:
                    raise ValueError(f"unknown setting {name}")
                merged[name] = tuple(value) if isinstance(value, list) else value
        for name in known:
            text = (os.environ if env is None else env).get(prefix + name.upper())
            if text is not None:
                merged[name] = _parsed(text, getattr(cls(), name))
        return cls(**merged)

    @classmethod
    def from_yaml(cls, *paths: str) -> StreamConfig:
        import yaml

        layers = []
        for path in paths:
            with open(path) as f:
                layers.append(yaml.safe_load(f) or {})
        return cls.layered(*layers)

    def with_(self, **changes: Any) -> StreamConfig:
        return replace(self, **changes)


def _parsed(text: str, like: Any) -> Any:
    if isinstance(like, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, int):
        return int(text)
    if isinstance(like, tuple):
        return tuple(x.strip() for x in text.split(",") if x.strip())
    return text


def only_tables(whitelist: Iterable[str], suffix: str = REFRESH_SUFFIX) -> list[str] | None:
    """Each listed table and its refresh table; listed refresh tables are left out; nothing listed means all (None)."""
    base = [t for t in whitelist if not t.endswith(suffix)]
    return [name for t in base for name in (t, t + suffix)] or None


def cluster_entry(topology: Iterable[Mapping[str, Any]], name: str, replica: str | None = None) -> Mapping[str, Any] | None:
    """The first entry of the first cluster of that name. With ``replica``, that must match too and a miss gives None."""
    for item in topology:
        if item["cluster"] == name and (replica is None or item.get("replica") == replica):
            return item["entries"][0]
    if replica is None:
        raise ValueError(f"no cluster {name} in the topology")
    return None


def is_set(name: str, env: Mapping[str, str] | None = None) -> bool:
    """Whether an environment variable is there, be it empty."""
    return name in (os.environ if env is None else env)


def server_id() -> int:
    """A random id for a reader of a source, from 1 to 2^32 - 1."""
    return secrets.randbelow((1 << 32) - 1) + 1


def unlist(values: list) -> Any:
    """Nothing, or the only element; more are an error."""
    if len(values) > 1:
        raise ValueError(f"one element expected, not {len(values)}")
    return values[0] if values else None
