"""Streams: following operation logs and event tables with Structured Streaming.

Every subscriber is a query of its own. Commits appear as new folders, so a file source sees each row once; what
compaction writes stands elsewhere. A checkpoint location makes a follower go on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def operations(ops: Any, name: str, op: str | None = None, since: float | None = None) -> DataFrame:
    """The rows of an operation log's namespace as a stream."""
    from polyfold.sources.oplog import COLUMNS

    fs = ops._fs()
    fs.mkdirs(ops._jpath("data"))
    d = ops.spark.readStream.schema(COLUMNS).option("recursiveFileLookup", "true").parquet(f"{ops.path}/data")
    d = d.where(F.col("name") == name)
    if op is not None:
        d = d.where(F.col("op") == op)
    return d if since is None else d.where(F.col("ts") >= since)


def table_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A Parquet table (file or folder) as a stream."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def each_row(stream: DataFrame, callback: Callable[[Row], None], checkpoint: str | None = None, interval: str = "100 milliseconds", once: bool = False) -> StreamingQuery:
    """Hands every new row to callback on the driver, in the order of ord where there is one: for control
    events, not for bulk data."""

    def run(batch: DataFrame, _: int) -> None:
        order = [c for c in ("ts", "ord") if c in batch.columns]
        for r in (batch.orderBy(*order) if order else batch).toLocalIterator():
            callback(r)

    w = stream.writeStream.foreachBatch(run)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()


def windowed(stream: DataFrame, time_col: str, seconds: int, aggs: list[Column], slide: int | None = None, late: int = 0) -> DataFrame:
    """Aggregates over event-time windows; state is dropped once the watermark, late seconds behind, passes."""
    s = stream.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", f"{late} seconds")
    out = s.groupBy(F.window("_t", f"{seconds} seconds", f"{slide or seconds} seconds").alias("w")).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def collect_now(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its rows from a memory table; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


class Events:
    """Named events: attach callbacks, emit, and follow a change feed."""

    def __init__(self) -> None:
        self._handlers: dict[str, list[Callable]] = {}

    def attach(self, event: str, callback: Callable) -> Callable[[], None]:
        known = self._handlers.setdefault(event, [])
        if callback not in known:
            known.append(callback)
        return lambda: self.detach(event, callback)

    def detach(self, event: str, callback: Callable) -> None:
        if callback in self._handlers.get(event, []):
            self._handlers[event].remove(callback)

    def emit(self, event: str, payload: Any = None) -> None:
        for f in list(self._handlers.get(event, [])):
            f(payload)

    def follow(self, stream: DataFrame, event_of: Callable[[Row], str], **options: Any) -> StreamingQuery:
        """Emits an event for each row of a stream."""
        return each_row(stream, lambda r: self.emit(event_of(r), r.asDict()), **options)
