"""Time-indexed logs. Rows: timestamp (epoch seconds, double), data (JSON text), and typed columns of declared fields."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyfold.functions import filters as P
from polyfold.operators import fieldindex

#: What keeps two entries with one time apart.
TICK = 1e-6


def epoch(ts: Column) -> Column:
    """Epoch seconds of a timestamp (without zone: UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def separated(d: DataFrame, time_col: str = "timestamp", tie: str | None = None) -> DataFrame:
    """Entries of one time are moved apart, one tick each, in the order of tie."""
    w = Window.partitionBy(time_col).orderBy(tie or time_col)
    return d.withColumn(time_col, F.col(time_col) + F.lit(TICK) * (F.row_number().over(w) - 1))


def monotonic(batch: list[tuple[float, str]], last: float | None) -> list[tuple[float, str]]:
    """A batch's entries with strictly growing times: what is not after the one before becomes one tick after it."""
    out = []
    for t, data in batch:
        if last is not None and t <= last:
            t = last + TICK
        out.append((t, data))
        last = t
    return out


def monotonic_frame(d: DataFrame, last: float | None, by: list[str], seq: str = "seq") -> DataFrame:
    """The same for DataFrames, in the order of seq within each log named by by.

    The rule is sequential, so a log's batch is one task; batches of logs run side by side.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        pdf["timestamp"] = [t for t, _ in monotonic(list(zip(pdf["timestamp"], [""] * len(pdf))), last)]
        return pdf

    return d.groupBy(*by).applyInPandas(run, d.schema)


def range_(
    d: DataFrame,
    start: float | None = None,
    end: float | None = None,
    where: list[P.Filter] | None = None,
    order: str = "ASC",
    limit: int | None = None,
    offset: int | None = None,
    manifest: fieldindex.Manifest | None = None,
    clock: str | None = None,
) -> DataFrame:
    """Entries from start to end, both included, that pass all filters, by time.

    clock: a column of d that timestamp was computed from, as a timestamp in UTC; bounds on it, a microsecond wider,
    reach the scan, where bounds on a computed column don't.

    Filters on fields that manifest holds complete become comparisons on typed columns, which reach the scan;
    others read the JSON text. offset works without limit.
    """
    if order not in ("ASC", "DESC"):
        raise ValueError("order must be ASC or DESC")
    if clock is not None:
        kind = dict(d.dtypes)[clock]
        at = lambda seconds, by: F.lit(datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=round(seconds * 1e6) + by)).cast("timestamp_ntz").cast(kind)
        if start is not None:
            d = d.where(F.col(clock) >= at(start, -1))
        if end is not None:
            d = d.where(F.col(clock) <= at(end, 1))
    if start is not None:
        d = d.where(F.col("timestamp") >= F.lit(float(start)))
    if end is not None:
        d = d.where(F.col("timestamp") <= F.lit(float(end)))
    if where:
        d = fieldindex.where(d, P.checked_filters(tuple(where)), manifest)
    d = d.orderBy(F.col("timestamp").desc() if order == "DESC" else F.col("timestamp").asc())
    if offset:
        d = d.offset(offset)
    return d if limit is None else d.limit(limit)


def count(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("n"))


def tumbling(d: DataFrame, seconds: int, aggs: list[Column], slide: int | None = None) -> DataFrame:
    """Windowed aggregates by event time."""
    t = F.timestamp_micros((F.col("timestamp") * 1e6).cast("long"))
    w = F.window(t, f"{seconds} seconds", f"{slide or seconds} seconds")
    out = d.groupBy(w.alias("w")).agg(*aggs)
    return out.select(epoch(F.col("w.start")).alias("window_start"), epoch(F.col("w.end")).alias("window_end"), *[c for c in out.columns if c != "w"])
