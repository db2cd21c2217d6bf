"""Priority queues. Rows: priority, timestamp, seq (breaks ties), data; the lowest priority goes first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["priority", "timestamp", "seq"]


def ordered(d: DataFrame) -> DataFrame:
    """All rows in the order they would be taken."""
    return d.orderBy(*ORDER)


def peek(d: DataFrame, n: int = 1) -> DataFrame:
    """The first n rows: TakeOrderedAndProject, no full sort."""
    return d.orderBy(*ORDER).limit(n)


def drain(d: DataFrame, n: int, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The first n rows (of each queue named by by) and the rows that stay."""
    if not by:
        taken = peek(d, n)
        return taken, d.join(taken.select("seq"), "seq", "left_anti")
    ranked = d.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*ORDER)))
    return ranked.where(F.col("_n") <= n).drop("_n"), ranked.where(F.col("_n") > n).drop("_n")


def count(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("n"))
