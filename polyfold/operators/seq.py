"""Ordered sequences. Rows: item_order (a fractional index, byte order) and item_value, by list if partition columns are given.

Positional reads sort within each list. A single unbounded list is dealt by ranges of its order and numbered part by part;
reads near either end are TakeOrderedAndProject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyfold.functions import fracdex


def _window(by: list[str], order: str, descending: bool = False):
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col(order).desc() if descending else F.col(order).asc())


#: Positions up to so far from an end are read by sorting that many rows only.
NEAR_END = 1000


def numbered(d: DataFrame, order: str = "item_order") -> DataFrame:
    """d with _i, each item's position, and _n, their number, without bringing the list together.

    Ranges of the order are numbered side by side; what meets is one count a range. Equal keys stand in one range.
    """
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A stated number of partitions, which adaptive execution leaves as it is, so a range keeps its number.
    ranges = d.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id())
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(every).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return ranges.withColumn("_r", rank).join(F.broadcast(sizes), "_p").withColumn("_i", F.col("_o") + F.col("_r") - 1).drop("_p", "_r", "_o")


def ordered(d: DataFrame, by: list[str] | None = None, order: str = "item_order") -> DataFrame:
    return d.orderBy(*(by or []), order)


def count(d: DataFrame, by: list[str] | None = None) -> DataFrame:
    return d.groupBy(*(by or [])).agg(F.count("*").alias("n"))


def at(d: DataFrame, index: int, by: list[str] | None = None, order: str = "item_order") -> DataFrame:
    """The item at index of each list; negative counts from the end; lists that are too short give none."""
    by = by or []
    if not by and not -NEAR_END <= index < NEAR_END:
        return numbered(d, order).where(F.col("_i") == (F.lit(index) if index >= 0 else F.col("_n") + index)).drop("_i", "_n")
    if not by:
        column = F.col(order).desc() if index < 0 else F.col(order).asc()
        return d.orderBy(column).offset(-index - 1 if index < 0 else index).limit(1)
    n = -index if index < 0 else index + 1
    return d.withColumn("_n", F.row_number().over(_window(by, order, index < 0))).where(F.col("_n") == n).drop("_n")


def slice_(d: DataFrame, start: int | None, stop: int | None, step: int | None = None, by: list[str] | None = None, order: str = "item_order") -> DataFrame:
    """Items from start up to stop of each list, with Python's clamping; only step 1."""
    if step not in (None, 1):
        raise ValueError("only a step of 1 is supported")
    if by:
        t = d.withColumn("_i", F.row_number().over(_window(by, order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    else:
        t = numbered(d, order)
    n, i = F.col("_n"), F.col("_i")

    def bound(x: int | None, missing: Column) -> Column:
        return missing if x is None else F.greatest(n + x, F.lit(0)) if x < 0 else F.least(F.lit(x), n)

    return t.where((i >= bound(start, F.lit(0))) & (i < bound(stop, n))).drop("_i", "_n")


def last(d: DataFrame, by: list[str] | None = None, order: str = "item_order") -> DataFrame:
    """What pop takes: no row for an empty list."""
    return at(d, -1, by, order)


def first(d: DataFrame, by: list[str] | None = None, order: str = "item_order") -> DataFrame:
    """What deque takes."""
    return at(d, 0, by, order)


def without(d: DataFrame, taken: DataFrame, by: list[str] | None = None, order: str = "item_order") -> DataFrame:
    return d.join(taken.select(*(by or []), order), [*(by or []), order], "left_anti")


def set_at(d: DataFrame, index: int, value: str, by: list[str] | None = None, order: str = "item_order") -> DataFrame:
    by = by or []
    hit = at(d, index, by, order).select(*by, order, F.lit(True).alias("_hit"))
    return d.join(hit, [*by, order], "left").withColumn("item_value", F.when(F.col("_hit"), F.lit(value)).otherwise(F.col("item_value"))).drop("_hit")


def delete_at(d: DataFrame, index: int, by: list[str] | None = None, order: str = "item_order") -> DataFrame:
    return without(d, at(d, index, by, order), by, order)


def contains(d: DataFrame, value: str) -> DataFrame:
    """present: whether any item has exactly this JSON text."""
    return d.where(F.col("item_value") == value).limit(1).agg((F.count("*") > 0).alias("present"))


def bounds_for_insert(d: DataFrame, index: int, order: str = "item_order") -> tuple[str | None, str | None]:
    """The keys that an insert at index goes between; below 1 it is the front, beyond the end the back."""
    if index <= 0:
        row = d.agg(F.min(order)).first()
        return None, row[0]
    if index < NEAR_END:
        near = [r[0] for r in d.select(order).orderBy(order).offset(index - 1).limit(2).collect()]
    else:
        near = [r[0] for r in numbered(d.select(order), order).where((F.col("_i") == index - 1) | (F.col("_i") == index)).orderBy("_i").collect()]
    if len(near) == 2:
        return near[0], near[1]
    return d.agg(F.max(order)).first()[0], None


def insert_key(d: DataFrame, index: int, order: str = "item_order") -> str:
    return fracdex.key_between(*bounds_for_insert(d, index, order))
