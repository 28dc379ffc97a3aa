"""Sessions with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "terrane", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skewed joins split; anything else by ``settings`` (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (fixed | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
