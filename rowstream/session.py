"""Session settings that every rowstream job assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps naive source timestamps unshifted; AQE re-plans skew and coalesces at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "rowstream", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session with the defaults above; ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
