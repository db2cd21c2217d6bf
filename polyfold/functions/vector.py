"""Distances between array columns and a literal vector, in double arithmetic and whole-stage code."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

#: Up to this dimension distances are written out term by term, which Spark compiles; above, as a fold over arrays.
UNROLL = 512


def _terms(v: Column, query: Sequence[float], term: Callable[[Column, Column], Column]) -> Column:
    if len(query) <= UNROLL:
        # Summed pairwise, so the expression stays shallow.
        level = [term(F.get(v, F.lit(i)).cast("double"), F.lit(float(x))) for i, x in enumerate(query)]
        while len(level) > 1:
            level = [reduce(lambda a, b: a + b, level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(v, q, lambda a, b: term(a.cast("double"), b)), F.lit(0.0), lambda s, x: s + x)


def dot(v: Column, query: Sequence[float]) -> Column:
    return _terms(v, query, lambda a, b: a * b)


def norm(v: Column, dim: int) -> Column:
    return F.sqrt(_terms(v, [0.0] * dim, lambda a, b: a * a))


def cosine(v: Column, query: Sequence[float]) -> Column:
    """(1 - cos) / 2, from 0 to 1; a zero vector gives 0.5."""
    q = float(np.sqrt(sum(float(x) * float(x) for x in query)))
    return (F.lit(1.0) - dot(v, query) / (norm(v, len(query)) * F.lit(q) + F.lit(1e-10))) / 2


def euclid(v: Column, query: Sequence[float]) -> Column:
    return F.sqrt(_terms(v, query, lambda a, b: (a - b) * (a - b)))


def manhattan(v: Column, query: Sequence[float]) -> Column:
    return _terms(v, query, lambda a, b: F.abs(a - b))


METRICS = {"cosine": cosine, "euclid": euclid, "manhattan": manhattan}


def custom(metric: Callable[[np.ndarray, np.ndarray], np.ndarray], v: Column, query: Sequence[float]) -> Column:
    """A metric of (N x D matrix, D vector) -> N scores, as an Arrow-batched UDF."""
    q = np.asarray(query, np.float32)

    def score(x: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(metric(np.stack(x.to_numpy()).astype(np.float32), q), float)) if len(x) else pd.Series([], dtype=float)

    return F.pandas_udf(score, DoubleType())(v)


def hyperplanes(dim: int, bits: int = 16, seed: int = 7) -> np.ndarray:
    """Orthonormal planes (at most dim of them) from a fixed seed, so every process has the same ones."""
    m, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, max(1, min(bits, dim)))))
    return m.T.astype(np.float32)


def bucket(v: Column, planes: np.ndarray) -> Column:
    """SimHash: one bit for each plane, the first plane's bit on top; one matrix product a batch. Null for null."""
    p, weights = planes.astype(float), 1 << np.arange(len(planes))[::-1]

    def hashed(x: pd.Series) -> pd.Series:
        some = x.dropna()
        if not len(some):
            return pd.Series([None] * len(x), index=x.index, dtype="Int32")
        got = (np.stack(some.to_numpy()).astype(float) @ p.T > 0) @ weights
        return pd.Series(got, index=some.index, dtype="Int32").reindex(x.index)

    return F.pandas_udf(hashed, IntegerType())(v)


def bucket_of(query: Sequence[float], planes: np.ndarray) -> int:
    bits = planes.astype(float) @ np.asarray(query, float) > 0
    return int(sum(1 << (len(bits) - 1 - i) for i, x in enumerate(bits) if x))


def probes(b: int, bits: int) -> list[int]:
    """The bucket itself and those one bit away."""
    return [b, *(b ^ (1 << i) for i in range(bits))]


def near_bucket(c: Column, b: int, bits: int, radius: int = 1) -> Column:
    """Whether a bucket is at most radius bits from b; for a radius of 1 as a list, which prunes partitions and files."""
    return c.isin(probes(b, bits)) if radius == 1 else F.bit_count(c.bitwiseXOR(F.lit(b))) <= radius
