"""Mixing sources to target weights (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyfold.llm import common as C

SEP_CLASS = "[\\x20\\x09-\\x0D]+"


def n_words(text: str) -> Column:
    """The number of words of a text (null: 0)."""
    t = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SEP_CLASS))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_rate: float = 3.0) -> DataFrame:
    """Targets of the sources: sizes (source, source_size) gains target.

    Sources in code point order, null last, weigh weights in turn, and share all of the sizes; a target stops
    at max_rate times its source's size and the excess is shared again by weight. The fixed point of that is
    target = least(max_rate * size, level * weight), where level follows from the sources in the order of
    the level at which they stop. One row per source enters the windows here, never documents.
    """
    one = Window.partitionBy(F.lit(0))
    w = sizes.withColumn("_rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = w.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    w = w.withColumn("_cap", F.lit(max_rate) * F.col("source_size")).withColumn("_stop", F.col("_cap") / F.col("_w"))
    order = one.orderBy("_stop", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(order), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(order), F.lit(0.0))))
    w = w.withColumn("_k", F.row_number().over(one.orderBy("_stop", "_rank")))
    free = F.when(F.col("_level") <= F.col("_stop"), F.struct("_k", "_level"))
    w = w.withColumn("_free", F.min(free).over(everything)["_level"])
    return w.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_free"), F.lit(0.0)) * F.col("_w")).alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_rate: float = 3.0, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document.

    Returns every row of docs with a struct(size, source_size, target, rate, copies) as its last column, named _mix
    (with more underscores if docs has that name; all columns of docs stay as they are). copies is floor(rate) plus
    one copy if the hash of seed and id, as a fraction of 2**32, is below what is left of the rate. No text or null
    text: size 0, and the copies still follow its source's rate; very long texts count whole. An empty table gives
    an empty table; a source without any words has rate 0. Sources that stop at one level go by rank. Repeated rows
    are decided alike, as the hash takes the id only (null: the text null). Reruns agree. Only sources meet in one
    task; documents are not shuffled unless the table of sources is too large to broadcast, and then adaptive
    execution splits a hot source.
    """
    n, name, of, out = C.fresh(docs.columns, "_size", "_source", "_of_source", "_mix")
    sized = docs.withColumn(n, n_words(text_col))
    t = source_targets(sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(n).alias("source_size")), weights, max_rate)
    t = t.select(F.col("source").alias(name), F.struct("source_size", "target").alias(of))
    j = sized.join(t, F.col(source_col).eqNullSafe(F.col(name)), "left")
    size, target = F.col(of)["source_size"], F.col(of)["target"]
    rate = F.when(size > 0, F.least(target / size, F.lit(max_rate))).otherwise(F.lit(0.0))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    copies = (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    mixed = F.struct(F.col(n).alias("size"), size.alias("source_size"), target.alias("target"), rate.alias("rate"), copies.alias("copies"))
    return j.select(*[j[c] for c in docs.columns], mixed.alias(out))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as plan_mix says, in the columns of docs."""
    p = plan_mix(docs, **options)
    (copy,) = C.fresh(p.columns, "_copy")
    return p.withColumn(copy, F.explode(F.array_repeat(F.lit(1), p[p.columns[-1]]["copies"].cast("int")))).select(*[p[c] for c in docs.columns])
