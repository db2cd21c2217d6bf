"""Labelled directed graphs. Rows: source, target, label, metadata (JSON text or null)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _labelled(d: DataFrame, label: str | None) -> DataFrame:
    return d if label is None else d.where(F.col("label") == label)


def link(d: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones in place of those of the same source, target and label; empty metadata is null."""
    keys = ["source", "target", "label"]
    new = new.withColumn("metadata", F.when(~F.coalesce("metadata", F.lit("")).isin("", "{}", "null"), F.col("metadata")))
    return d.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*d.columns).dropDuplicates(keys))


def unlink(d: DataFrame, gone: DataFrame) -> DataFrame:
    keys = ["source", "target", "label"]
    return d.join(gone.select(*keys), keys, "left_anti")


def linked(d: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (source, target, label) with present."""
    keys = ["source", "target", "label"]
    return pairs.join(d.select(*keys).distinct().withColumn("_p", F.lit(True)), keys, "left").withColumn("present", F.coalesce("_p", F.lit(False))).drop("_p")


def get(d: DataFrame, source: Any, target: Any, label: str) -> DataFrame:
    return d.where((F.col("source") == F.lit(source)) & (F.col("target") == F.lit(target)) & (F.col("label") == label))


def edges(d: DataFrame, source: Any, label: str | None = None) -> DataFrame:
    """The out-edges of a node, with metadata."""
    return _labelled(d.where(F.col("source") == F.lit(source)), label)


def children(d: DataFrame, source: Any, label: str | None = None) -> DataFrame:
    """node: targets of the out-edges; once for each label."""
    return edges(d, source, label).select(F.col("target").alias("node"))


def parents(d: DataFrame, target: Any, label: str | None = None) -> DataFrame:
    """node: sources of the in-edges."""
    return _labelled(d.where(F.col("target") == F.lit(target)), label).select(F.col("source").alias("node"))


def children_of(d: DataFrame, frontier: DataFrame, label: str | None = None) -> DataFrame:
    """source, node for every node of frontier (column node): one join for a whole set."""
    f = frontier.select(F.col("node").alias("source")).distinct()
    return _labelled(d, label).join(f, "source", "left_semi").select("source", F.col("target").alias("node"))


def walk(d: DataFrame, start: DataFrame, depth: int, label: str | None = None, checkpoint: bool | None = None) -> DataFrame:
    """node, depth: nodes within so many hops of start (column node), each at its least depth. An extension.

    A level is one join and one anti-join against all nodes seen, so cycles end by themselves. Levels are checkpointed, so that none
    is computed again for the next, unless checkpoint is False; by default where there is a checkpoint folder.
    """
    if checkpoint is None:
        checkpoint = d.sparkSession.sparkContext.getCheckpointDir() is not None
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):
        step = children_of(d, frontier, label).select("node").distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level))
        if checkpoint:
            step = step.checkpoint()
        seen, frontier = seen.union(step), step
    return seen


def count(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("n"))
