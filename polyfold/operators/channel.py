"""Message channels. Rows: timestamp, channel, payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def history(d: DataFrame, channel: str, limit: int = 100) -> DataFrame:
    """The last messages of a channel, oldest first: a top-n, then a sort of n rows."""
    return d.where(F.col("channel") == channel).orderBy(F.col("timestamp").desc()).limit(limit).orderBy("timestamp")


def count(d: DataFrame, channel: str) -> DataFrame:
    return d.where(F.col("channel") == channel).agg(F.count("*").alias("n"))


def since(d: DataFrame, channel: str, after: float) -> DataFrame:
    """Messages after a time, as a subscriber that joined then would see them."""
    return d.where((F.col("channel") == channel) & (F.col("timestamp") > after)).orderBy("timestamp")
