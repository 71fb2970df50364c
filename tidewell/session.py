"""Session defaults that every entry point shares."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[*]", app: str = "tidewell", **conf: str) -> SparkSession:
    """A UTC, adaptive, Arrow-enabled session; ``conf`` overrides any default."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    builder = SparkSession.builder.master(master).appName(app)
    return builder.config(map={**defaults, **conf}).getOrCreate()
