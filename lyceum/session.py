"""Session settings every entry point shares."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE does three jobs here: it merges small shuffle partitions, splits skewed join
# partitions and turns a join into a broadcast once a side has proved small.
SETTINGS = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",  # saves a call-site lookup per expression
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "lyceum", master: str | None = None, **extra: str) -> SparkSession:
    """Create or fetch a session.  ``extra`` keys use ``__`` for ``.``: ``spark__ui__enabled="false"``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
