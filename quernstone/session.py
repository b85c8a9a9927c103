"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quernstone", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf adds to these settings or replaces them."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
