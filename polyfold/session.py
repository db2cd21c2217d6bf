"""A session with the settings the library expects; any session with UTC as its time zone will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution stays on: it sizes shuffles, splits skewed joins and picks broadcasts by measured size."""
    b = SparkSession.builder.appName("polyfold").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.config(map=conf).getOrCreate()
