"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Training is histogram boosting of logistic loss in numpy on a bounded sample of labelled rows; the trees are
flattened into node arrays (feature, threshold, left, right, value) that score many documents at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyfold.llm import common as C
from polyfold.llm import stats as S

#: Features whose growth may only lower the score (-1).
FALLING = {"symbols": -1, "upper": -1, "exclaim": -1, "bars": -1, "repeats": -1, "dup_lines": -1, "echoes": -1}
#: At most so many labelled rows are fitted on: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000


@dataclass
class Trees:
    """Flattened trees; a leaf's feature is -1. Trees are runs of nodes from roots on."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1 for the rows of x."""
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[row, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 2.0, least: float = 8.0) -> Trees:
    """Boosts n_trees trees; monotone holds -1, 0 or 1 for each feature.

    A constrained split must order its children's values, and the children's subtrees are held on either
    side of the middle, so the whole ensemble is monotone. No rows or one label only: a constant.
    """
    n, p = x.shape
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
        code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        raw = np.full(n, base)
        for _ in range(n_trees):
            prob = 1 / (1 + np.exp(-raw))
            g, h = y - prob, prob * (1 - prob)
            step = np.zeros(n)

            def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
                me = len(nodes)
                total_g, total_h = g[rows].sum(), h[rows].sum()
                leaf = float(np.clip(total_g / (total_h + ridge), low, high))
                nodes.append([-1, 0.0, -1, -1, leaf * rate])
                best = (1e-6, -1, -1, 0.0, 0.0)
                if level < depth and len(rows) >= 2 * least:
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        k = code[rows, j]
                        sg, sh, sn = (np.cumsum(np.bincount(k, weights=w, minlength=len(c) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                        vl, vr = np.clip(sg / (sh + ridge), low, high), np.clip((total_g - sg) / (total_h - sh + ridge), low, high)
                        gain = lambda G, H, v: G * v - 0.5 * (H + ridge) * v * v
                        won = gain(sg, sh, vl) + gain(total_g - sg, total_h - sh, vr) - gain(total_g, total_h, leaf)
                        won[(sn < least) | (len(rows) - sn < least) | (monotone[j] * (vr - vl) < 0)] = -1
                        i = int(np.argmax(won))
                        if won[i] > best[0]:
                            best = (float(won[i]), j, i, float(vl[i]), float(vr[i]))
                if best[1] < 0:
                    step[rows] = leaf * rate
                    return me
                _, j, i, vl, vr = best
                mid = (vl + vr) / 2
                lows, highs = ((low, mid), (mid, high)), ((mid, high), (low, mid))
                (l0, l1), (r0, r1) = lows if monotone[j] > 0 else highs if monotone[j] < 0 else ((low, high), (low, high))
                go = code[rows, j] <= i
                a = grow(rows[go], level + 1, l0, l1)
                b = grow(rows[~go], level + 1, r0, r1)
                nodes[me] = [j, float(cuts[j][i]), a, b, 0.0]
                return me

            roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
            raw += step
    t = np.array(nodes, float).reshape(-1, 5)
    return Trees(t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4], np.array(roots, int), base)


def labelled_sample(stats: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, id_col: str = "doc_id", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most limit labelled documents, those with the smallest id hashes."""
    picked = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id is not null and y is not null")
    picked = picked.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    # Bounded by limit, so it may be broadcast.
    rows = stats.select("doc_id", "features").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "features", "y").orderBy("doc_id", "features").limit(limit).toArrow()
    x = rows["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(S.FEATURES))
    return x, (rows["y"].to_numpy() > 0).astype(float)


def learn_rules(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label_col: str = "quality") -> Trees:
    """The trees for documents' statistics; without labels they are a constant."""
    x, y = labelled_sample(stats, labels, sample_rows, label_col=label_col)
    return fit_trees(x, y, np.array([FALLING.get(f, 0) for f in S.FEATURES]))


def apply_rules(docs: DataFrame, labels: DataFrame, keep_at: float = 0.5, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, the statistics of stats.SCHEMA without features, score and verdict (score >= keep_at) of every row.

    Null or empty texts have zero statistics and are scored like any other; very long ones count whole. Repeated ids
    give repeated rows; of several labels of one id the largest counts, and labels without an id or a value don't. A score
    of exactly keep_at keeps. Without labels every score is the constant 0.5. An empty table gives an empty table.
    Only sample_rows labelled rows reach the driver. Other columns are not read.
    """
    spark = docs.sparkSession
    stats = C.written(S.with_stats(docs, id_col, text_col), spark)
    trees = learn_rules(stats, labels, sample_rows, label_col)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batch: pa.RecordBatch):
        x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(S.FEATURES))
        score = trees.score(x)
        yield {c: batch.column(c) for c in names} | {"score": score, "verdict": score >= keep_at}

    return C.arrow_map(stats, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, verdict boolean")
