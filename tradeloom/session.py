"""Session settings the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution coalesces small shuffle partitions, switches to broadcast
#: joins from measured sizes and splits skewed join partitions.
#: ``forceOptimizeSkewedJoin`` keeps the split even when it costs one more shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "tradeloom", master: str | None = None, **extra: str) -> SparkSession:
    """Create or reuse a session. ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
