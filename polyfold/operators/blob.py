"""Binary objects. Rows: key, data (binary), metadata (JSON text or null)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_bytes(data: Any) -> bytes:
    if not isinstance(data, bytes):
        raise TypeError("blob data must be bytes")
    return data


def put(d: DataFrame, new: DataFrame) -> DataFrame:
    return d.join(new.select("key"), "key", "left_anti").unionByName(new.select(*d.columns))


def fetch(d: DataFrame, key: Any) -> DataFrame:
    return d.where(F.col("key") == F.lit(key))


def items(d: DataFrame) -> DataFrame:
    """key, size and metadata, without reading more of data than its length."""
    return d.select("key", F.octet_length("data").alias("size"), "metadata")


def contains(d: DataFrame, key: Any) -> DataFrame:
    return fetch(d, key).limit(1).agg((F.count("*") > 0).alias("present"))


def keys(d: DataFrame) -> DataFrame:
    return d.select("key").orderBy("key")


def count(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("n"))
