"""The engine's Spark session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "loomworks", **conf) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds settings (underscores stand for dots)."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
