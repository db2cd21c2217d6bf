"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyfold.llm import common as C
from polyfold.llm import stats as S

#: Bins of raw scores that calibration counts labels in.
BINS = 512


@dataclass
class Kernel:
    """Standardised statistics times random frequencies: cosines that approximate a Gaussian kernel."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, scale: np.ndarray, size: int, width: float, seed: int) -> Kernel:
        rng = np.random.default_rng(seed)
        return cls(mean, scale, rng.normal(0, 1 / width, (len(mean), size)), rng.uniform(0, 2 * np.pi, size))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / self.w.shape[1]), z / 6, np.ones((len(x), 1))], 1)


def isotonic(count: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins in order; a bin without rows takes its neighbours' pool."""
    pools: list[list[float]] = []
    for i, (n, k) in enumerate(zip(count, ones)):
        pools.append([k, n, i, i])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            k2, n2, _, end = pools.pop()
            pools[-1] = [pools[-1][0] + k2, pools[-1][1] + n2, pools[-1][2], end]
    out = np.zeros(len(count))
    for k, n, a, b in pools:
        out[a : b + 1] = (k + 0.5) / (n + 1)
    return np.maximum.accumulate(out)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(S.FEATURES))


@dataclass
class Model:
    kernel: Kernel
    theta: np.ndarray
    low: float
    high: float
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.theta

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.clip((self.raw(x) - self.low) / max(self.high - self.low, 1e-9), 0, 1) * len(self.levels) - 0.5
        return np.clip(np.interp(at, np.arange(len(self.levels)), self.levels), 0, 1)


def fit(stats: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, size: int = 160, width: float = 4.0, ridge: float = 1.0, seed: int = 10, label_col: str = "quality") -> Model:
    """Fits on all labelled rows outside the held-out fold.

    A quarter of them by another hash calibrates. Every step sums within partitions first; what the driver
    gets is bounded by the number of features and bins, not by rows. Without labels: a constant 0.5.
    """
    lab = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id is not null and y is not null").groupBy("_id").agg((F.max("y") > 0).cast("double").alias("y"))
    rows = stats.select("doc_id", "features").where(C.crc_fold("doc_id", fold) != held).join(lab, F.col("doc_id") == F.col("_id"))
    rows = C.written(rows.select("features", "y", (F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0).alias("cal")), stats.sparkSession)
    p = len(S.FEATURES)
    m = rows.agg(F.count("*").alias("n"), *[f(F.col("features")[i]).alias(f"{k}{i}") for i in range(p) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not m["n"]:
        C.discard(rows)
        return Model(Kernel.draw(np.zeros(p), np.ones(p), size, width, seed), np.zeros(size + p + 1), 0.0, 1.0, np.full(2, 0.5))
    kernel = Kernel.draw(np.array([m[f"m{i}"] for i in range(p)]), np.maximum([m[f"s{i}"] for i in range(p)], 1e-3), size, width, seed)
    d = size + p + 1
    upper = np.triu_indices(d)

    def sums(batches):
        a, v = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            z, y = kernel(_matrix(batch)), batch.column("y").to_numpy()
            a, v = a + z.T @ z, v + z.T @ y
        flat = np.concatenate([a[upper], v])
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(flat)), pa.int32()), "x": pa.array(flat)})

    flat = np.zeros(len(upper[0]) + d)
    got = rows.where("not cal").select("features", "y").mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    flat[got["i"].to_numpy()] = got["x"].to_numpy()
    a = np.zeros((d, d))
    a[upper] = flat[:-d]
    a = a + a.T - np.diag(np.diag(a))
    theta = np.linalg.solve(a + ridge * np.eye(d), flat[-d:])
    model = Model(kernel, theta, -0.25, 1.25, np.full(2, 0.5))

    def binned(batch: pa.RecordBatch):
        raw = np.clip((model.raw(_matrix(batch)) - model.low) / (model.high - model.low), 0, 1 - 1e-9)
        yield {"bin": (raw * BINS).astype(np.int32), "y": batch.column("y")}

    bins = C.arrow_map(rows.where("cal").select("features", "y"), binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("k")).toArrow()
    n, k = np.zeros(BINS), np.zeros(BINS)
    n[bins["bin"].to_numpy()], k[bins["bin"].to_numpy()] = bins["n"].to_numpy(), bins["k"].to_numpy()
    C.discard(rows)
    if n.sum():
        model.levels = isotonic(n, k)
    return model


def classify(docs: DataFrame, labels: DataFrame, accept_at: float = 0.7, fold: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", row_col: str | None = None, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= accept_at) of every row of docs.

    Null and empty texts have zero statistics and a score like any other; very long ones count whole. Repeated
    rows give repeated rows, and a null id is the empty text in folds. Of several labels of one id the largest counts; labels
    without an id or a value don't, and without any all scores are 0.5. A score of exactly accept_at is 1. An
    empty table gives an empty table. Only statistics of the text enter a score; other columns are not read.
    row_col: a long column of docs that results carry as well, to tell rows with one id apart.
    """
    spark = docs.sparkSession
    more = [row_col] if row_col else []
    stats = C.written(S.with_stats(docs, id_col, text_col, row_col).select("doc_id", *more, "features"), spark)
    model = fit(stats, labels, fold, held, label_col=label_col, **options)

    def run(batch: pa.RecordBatch):
        yield {c: batch.column(c) for c in ("doc_id", *more)} | {"score": model.score(_matrix(batch))}

    scored = C.arrow_map(stats, run, ", ".join([f"{c} long" for c in ("doc_id", *more)] + ["score double"]))
    return scored.select("doc_id", *more, (C.crc_fold("doc_id", fold) == held).alias("held_out"), "score", (F.col("score") >= accept_at).cast("int").alias("predicted"))
