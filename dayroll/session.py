"""Session settings that the library's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "dayroll", **conf: str) -> SparkSession:
    """A session with UTC as its zone and adaptive execution on; conf adds to that."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def healthy(spark: SparkSession) -> bool:
    """Does the session answer?"""
    return spark.sql("select 1 as one").first().one == 1
