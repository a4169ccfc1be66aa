"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # joins are planned from measured sizes, hot join keys are split at run time
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # vector means keep one object per topic: combine thousands of topics map-side
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192",
    # 64-wide to 768-wide vectors: bound the bytes of one Arrow batch
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def build_session(app_name: str = "agoraflow", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session with ``SETTINGS``; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
