"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quillmere", **settings: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; everything else, partition counts included, comes from the cluster or from settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
