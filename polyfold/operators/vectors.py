"""Nearest neighbours. Rows: item_id, vector (array<float>), metadata (JSON text), and bucket where an index is used."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyfold.functions import filters as P
from polyfold.functions import jsonval
from polyfold.functions import vector as V

#: From so many rows on, auto takes the index.
AUTO_ROWS = 10_000


def check_vector(v: Sequence[float], dim: int | None) -> list[float]:
    x = np.asarray(v, np.float32)
    if x.ndim != 1 or (dim is not None and len(x) != dim):
        raise ValueError(f"expected a vector of {dim} numbers")
    return [float(a) for a in x]


def with_bucket(d: DataFrame, planes: np.ndarray, column: str = "vector") -> DataFrame:
    """The bucket is a column of the row, so an updated vector never stays in an old bucket."""
    return d.withColumn("bucket", V.bucket(F.col(column), planes))


def _candidates(d: DataFrame, candidate_ids: list[Any] | None, filters: list[P.Filter] | None) -> DataFrame:
    if candidate_ids is not None:
        d = d.where(F.col("item_id").isin(list(candidate_ids))) if candidate_ids else d.limit(0)
    if filters:
        d = jsonval.parsed(d, "metadata").where(P.scan_condition(P.checked_filters(tuple(filters)), F.col("_json"))).drop("_json")
    return d


def _ranked(d: DataFrame, query: Sequence[float], k: int, metric: str | Callable) -> DataFrame:
    if callable(metric):
        d = d.withColumn("score", V.custom(metric, F.col("vector"), query))
    elif metric in V.METRICS:
        d = d.withColumn("score", V.METRICS[metric](F.col("vector"), query))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return d.orderBy("score", "item_id").limit(k).withColumn("score", F.greatest("score", F.lit(0.0))).orderBy("score", "item_id")


def near(
    d: DataFrame,
    query: Sequence[float],
    k: int = 10,
    candidate_ids: list[Any] | None = None,
    filters: list[P.Filter] | None = None,
    metric: str | Callable = "cosine",
    method: str = "exact",
    planes: np.ndarray | None = None,
    radius: int = 1,
) -> DataFrame:
    """The k rows nearest to query with their score, nearest first; ties go by item_id.

    exact scores every row and keeps k a task. lsh scores rows in buckets at most radius bits
    from the query's, and all rows if those hold none; a radius of 1 suits clustered data, spread-out data needs more. auto takes lsh from AUTO_ROWS rows on.
    """
    if method not in ("exact", "lsh", "auto"):
        raise ValueError(f"unknown method {method!r}")
    rows = _candidates(d, candidate_ids, filters)
    if method == "auto":
        method = "lsh" if planes is not None and d.count() >= AUTO_ROWS else "exact"
    if method == "lsh":
        if planes is None:
            raise ValueError("lsh needs the index's planes")
        some = rows.where(V.near_bucket(F.col("bucket"), V.bucket_of(query, planes), len(planes), radius))
        if not some.isEmpty():
            rows = some
    return _ranked(rows, query, k, metric)


#: Queries and rows of the blocks that near_each compares.
QUERY_BLOCK, ROW_BLOCK = 1024, 4096


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _nearest(m: np.ndarray, x: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unit queries m and rows x: query, row and score of each query's k nearest rows; ties go by order (row numbers by id)."""
    rough = (1 - m @ x.T) / 2
    n = min(k, len(x))
    last = np.partition(rough, n - 1, axis=1)[:, n - 1] + 1e-9
    query, row, score = [], [], []
    for i in range(len(m)):
        at = order[rough[i, order] <= last[i]]
        s = (1 - (x[at] * m[i]).sum(1)) / 2  # the same for equal rows, which a matrix product need not be
        best = np.argsort(s, kind="stable")[:n]
        query.append(np.full(n, i))
        row.append(at[best])
        score.append(s[best])
    return np.concatenate(query), np.concatenate(row), np.concatenate(score)


def near_each(d: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, item_id, score: for each row of queries (query_id, vector), any number, the k nearest of d by cosine.

    Blocks of queries meet blocks of rows, and k rows for each query and block of rows go on. Ties go by item_id.
    query_id and item_id are long.
    """
    import pyarrow as pa
    import pyarrow.compute
    from pyspark.sql import Window

    def blocks(rows: DataFrame, key: str, size: int, names: str) -> DataFrame:
        ids, data = names.split()

        def run(batches):
            for b in batches:
                for i in range(0, b.num_rows, size):
                    part = b.slice(i, size)
                    x = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float32)
                    yield pa.RecordBatch.from_pydict({ids: pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), data: pa.array([x.tobytes()], pa.binary())})

        return rows.where("vector is not null").select(F.col(key).cast("long"), "vector").mapInArrow(run, f"{ids} array<long>, {data} binary")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, items = b.column("ids")[i].values, b.column("items")[i].values
                m, x = (_unit(np.frombuffer(b.column(c)[i].as_buffer(), np.float32).reshape(len(y), -1).astype(np.float64)) for c, y in (("m", ids), ("x", items)))
                q, r, s = _nearest(m, x, pa.compute.sort_indices(items, null_placement="at_start").to_numpy(), k)
                yield pa.RecordBatch.from_pydict({"query_id": ids.take(pa.array(q)), "item_id": items.take(pa.array(r)), "score": pa.array(s)})

    pairs = blocks(queries, "query_id", QUERY_BLOCK, "ids m").crossJoin(blocks(d, "item_id", ROW_BLOCK, "items x"))
    got = pairs.mapInArrow(run, "query_id long, item_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "item_id")
    return got.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("query_id", "item_id", "score")


def near_many(d: DataFrame, queries: list[tuple[Any, Sequence[float]]], k: int = 10) -> DataFrame:
    """query_id, item_id, score: the k nearest by cosine for a stated set of queries, all in one scan.

    Every task keeps k candidates a query with one matrix product a batch; what meets at the end is k rows
    for each query and task.
    """
    import pyarrow as pa
    import pyarrow.compute

    ids = [q for q, _ in queries]
    m = np.array([v for _, v in queries], np.float64)
    m = _unit(m)
    id_type = dict(d.dtypes)["item_id"]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack(b.column("vector").to_numpy(zero_copy_only=False)).astype(np.float64)
            order = pa.compute.sort_indices(b.column("item_id"), null_placement="at_start").to_numpy()
            query, at, score = _nearest(m, _unit(x), order, k)
            yield pa.RecordBatch.from_pydict({"query": pa.array(query), "item_id": b.column("item_id").take(pa.array(at)), "score": pa.array(score)})

    from pyspark.sql import Window

    got = d.select("item_id", "vector").where("vector is not null").mapInArrow(run, f"query long, item_id {id_type}, score double")
    w = Window.partitionBy("query").orderBy("score", "item_id")
    got = got.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    names = d.sparkSession.createDataFrame(list(enumerate(ids)), "query long, query_id long")
    return got.join(F.broadcast(names), "query").select("query_id", "item_id", "score")
