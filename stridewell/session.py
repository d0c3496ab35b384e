"""The Spark session that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "stridewell", **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive execution; further settings by name, with dots written as double underscores."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
