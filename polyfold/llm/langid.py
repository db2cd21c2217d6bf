"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyfold.llm import common as C

BUCKETS = 4096
#: At most so many rows are trained on, shared evenly among the languages: those with the smallest hashes of their ids.
SAMPLE_ROWS = 2400
#: Letters fold to lower case, all else in ASCII to a space, so subwords run within words.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def subword_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of hashed three- and four-byte subwords for each document; texts count whole."""
    n = len(offs) - 1
    out = np.zeros(n * BUCKETS, np.int64)
    if len(data) >= 3:
        base = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(offs))
        c = _FOLD[data]
        inside = (c[:-2] != 32) | (c[1:-1] != 32)
        for k in (3, 4):
            if len(data) < k:
                continue
            g = c[: len(c) - k + 1].copy()
            for i in range(1, k):
                g = (g << np.uint32(8)) | c[i : len(c) - k + 1 + i]
            b = (g * np.uint32(2654435761) ^ np.uint32(k * 0x51ED27)) * np.uint32(0x85EBCA6B) >> np.uint32(20)
            ok = inside[: len(g)] & (base[: len(g)] == base[k - 1 :])
            out += np.bincount(base[: len(g)][ok] + b[ok], minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each document has a letter of any script."""
    count = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = count[offs[1:]] > count[offs[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[i] = any(map(str.isalpha, data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


@dataclass
class Model:
    """table: the product of embeddings and softmax weights, one row of logits for each bucket."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, counts: np.ndarray) -> np.ndarray:
        x = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        z = (x @ self.table + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(counts: np.ndarray, langs: list[str], dim: int = 16, epochs: int = 30, rate: float = 6.0, batch: int = 32, seed: int = 9, reject_share: float = 0.01) -> Model | None:
    """SGD on four fifths of the rows; the rest sets the temperature and the rejection threshold.

    reject_below is the score under which reject_share of the right predictions of the calibration rows fall.
    """
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    y = np.searchsorted(labels, langs)
    x = (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)
    order = rng.permutation(len(y))
    cal, fit = (order[::5], np.setdiff1d(order, order[::5])) if len(y) >= 50 else (order, order)
    # Features are averages of some hundred subwords: scaling evens out common and rare buckets.
    idf = np.log1p(len(fit) / (1 + (x[fit] > 0).sum(0))).astype(np.float32)
    x *= idf
    emb = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    soft = np.zeros((dim, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
            h = x[at] @ emb
            z = h @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            back = p @ soft.T
            soft -= lr * (h.T @ p)
            bias -= 0.1 * lr * p.sum(0)
            emb -= lr * (x[at].T @ back)
    table = (emb @ soft) * idf[:, None]
    model = Model(labels, table.astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    best = (np.inf, 1.0)
    for t in np.geomspace(0.25, 8, 41):
        model.temperature = t
        best = min(best, (float(-np.log(model.predict(counts[cal])[np.arange(len(cal)), y[cal]] + 1e-9).mean()), float(t)))
    model.temperature = best[1]
    p = model.predict(counts[cal])
    right = p.max(1)[p.argmax(1) == y[cal]]
    model.reject_below = float(np.quantile(right, reject_share)) if len(right) else 0.0
    return model


def learn(docs: DataFrame, fold: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model for rows of doc_id, text and lang; None without any to learn from."""
    train_rows = docs.where((C.crc_fold("doc_id", fold) != held) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    train_rows = train_rows.withColumn("h", F.xxhash64(F.lit("langid"), "doc_id"))
    # Languages get even shares, and what a rare one leaves goes to the others. One row a language reaches the driver.
    known = sorted((r["n"], r["lang"], r["low"]) for r in train_rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("low")).collect())
    room, picked, most = sample_rows, F.lit(False), F.lit(0)
    for i, (n, lang, low) in enumerate(known):
        share = min(n, max(1, room // (len(known) - i)))
        room -= share
        # Hashes are even, so those below this are the share and a little more.
        upto = max(low, min(2**63 - 1, -(2**63) + int(2**64 * min(1, (share + 4 * share**0.5 + 20) / n))))
        mine = F.col("lang") == F.lit(lang)
        picked, most = picked | (mine & (F.col("h") <= F.lit(upto))), F.when(mine, F.lit(share)).otherwise(most)

    def counted(batch: pa.RecordBatch):
        for i, j, data, offs in C.pieces(batch.column(1), rows=512):
            counts = subword_counts(data, offs).astype(np.int32)
            yield {"h": batch.column(0).slice(i, j - i), "lang": batch.column(2).slice(i, j - i), "counts": pa.array([c.tobytes() for c in counts], pa.binary())}

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "counts"))
    got = C.arrow_map(train_rows.where(picked).select("h", "text", "lang"), counted, "h long, lang string, counts binary").withColumn("i", rank).where(F.col("i") <= most).orderBy("h", "lang", "counts").select("lang", "counts").toArrow()
    counts = np.frombuffer(b"".join(x.as_py() for x in got["counts"]), np.int32).reshape(-1, BUCKETS)
    return train(counts, got["lang"].to_pylist()) if len(counts) else None


def identify(docs: DataFrame, fold: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row.

    Learns from at most sample_rows rows with text and lang outside the held-out fold, as many of each language as
    there are, or else an even share (at least one row, so every language is learned). A null text, one
    without a letter, and any text when there is nothing to learn from are und with score 0. rejected marks
    scores below the calibrated threshold; the prediction stays. Ties go to the language that sorts first. Very long texts count
    whole. Repeated rows give repeated rows, and a null id is the empty text in folds. An empty table gives an
    empty table. Other columns are not read.
    """
    at = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    model = learn(at, fold, held, sample_rows)

    def run(batch: pa.RecordBatch):
        for i, j, data, offs in C.pieces(batch.column(1), rows=512):
            n = j - i
            lang, score = np.full(n, "und", object), np.zeros(n)
            known = has_letter(data, offs)
            if model is not None and known.any():
                p = model.predict(subword_counts(data, offs))
                lang[known] = np.array(model.labels, object)[p.argmax(1)[known]]
                score[known] = p.max(1)[known]
            yield {"doc_id": batch.column(0).slice(i, n), "lang_pred": pa.array(lang, pa.string()), "score": score, "rejected": known & (score < (model.reject_below if model else 0))}

    out = C.arrow_map(at.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (C.crc_fold("doc_id", fold) == held).alias("held_out"), "lang_pred", "score", "rejected")
