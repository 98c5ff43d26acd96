"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "lagweave", master: str | None = None, **options: str) -> SparkSession:
    """A session with UTC times and adaptive execution; ``options`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in options.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
