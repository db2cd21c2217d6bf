"""Statistics of whole documents, computed by numpy kernels over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from polyfold.llm import common as C

SYMBOLS = b"#*$%&|<>"
FEATURES = ["log_words", "word_chars", "symbols", "upper", "exclaim", "bars", "repeats", "dup_lines", "digits", "non_ascii", "line_words", "stops", "echoes"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"


def _classes() -> np.ndarray:
    """Byte by statistic: separators, code points, symbols, upper, letters, '!', '|', digits, over 127, sentence marks."""
    b = np.arange(256)
    rows = [C.IS_SEP, (b < 128) | (b >= 192), np.isin(b, list(SYMBOLS)), (b >= 65) & (b <= 90), ((b | 32) >= 97) & ((b | 32) <= 122), b == 33, b == 124, (b >= 48) & (b <= 57), b >= 192, np.isin(b, list(b".,;:?"))]
    return np.stack(rows, 1).astype(np.float64)


CLASSES = _classes()


def document_stats(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics for the documents of one piece.

    Windows of five words are equal if their words are, case included. Lines end at \\n only. Empty
    documents have zeros.
    """
    n = len(offs) - 1
    doc_of_byte = np.repeat(np.arange(n), np.diff(offs))
    counts = np.bincount((doc_of_byte << 8) | data, minlength=n << 8).reshape(n, 256) @ CLASSES
    sep, points, sym, upper, letters, bang, bar, digit, high, stop = counts.T
    starts, ends, first = C.words(data, offs)
    n_words = np.diff(first)
    # Words in five-word windows that are found twice or more.
    repeated = np.zeros(n)
    echoes = np.zeros(n)
    doc, h = C.owner(first), C.string_hash(data, starts, ends)
    if len(starts) >= 2:
        echoes = np.bincount(doc[1:], weights=(h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), minlength=n)
    if len(starts) >= 5:
        h = C.grams(h, 5)
        at = np.flatnonzero(doc[: len(h)] == doc[4:])
        if len(at):
            key = C.mix(h[at] ^ (doc[at].astype(C.U64) * C.U64(0x9E3779B97F4A7C15)))
            order = np.argsort(key, kind="stable")
            k = key[order]
            same = k[1:] == k[:-1]
            twice = np.zeros(len(k), bool)
            twice[1:] |= same
            twice[:-1] |= same
            hit = at[order[twice]]
            cover = np.bincount(hit, minlength=len(starts) + 5) - np.bincount(hit + 5, minlength=len(starts) + 5)
            covered = np.cumsum(cover)[: len(starts)] > 0
            repeated = np.bincount(doc, weights=covered, minlength=n)
    # Lines with a word that equal an earlier line of their document.
    breaks = np.flatnonzero(data == 10)
    a = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    a = a[a < len(data)]
    b = np.minimum(np.concatenate([a[1:], [len(data)]]), len(data))
    lines = np.zeros(n)
    dup = np.zeros(n)
    if len(a):
        has = np.searchsorted(starts, b) > np.searchsorted(starts, a)
        a, b = a[has], b[has]
        d = np.searchsorted(offs, a, "right") - 1
        lines = np.bincount(d, minlength=n).astype(float)
        b = b - ((b > a) & (data[b - 1] == 10))
        key = C.mix(C.string_hash(data, a, b) ^ (d.astype(C.U64) * C.U64(0x9E3779B97F4A7C15)))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(order), bool)
        again[1:] = key[order][1:] == key[order][:-1]
        dup = np.bincount(d[order[again]], minlength=n).astype(float)
    w, chars = np.maximum(n_words, 1), np.maximum(points - sep, 1)
    features = np.stack([np.log1p(n_words), np.log1p((points - sep) / w), sym / chars, upper / np.maximum(letters, 1), bang / w, bar / w, repeated / w, dup / np.maximum(lines, 1), digit / chars, high / chars, np.log1p(n_words / np.maximum(lines, 1)), stop / w, echoes / w], 1)
    as_long = lambda x: x.astype(np.int64)
    return {"n_words": as_long(n_words), "word_chars": as_long(points - sep), "n_symbols": as_long(sym), "n_dup_lines": as_long(dup), "n_repeat_words": as_long(repeated), "features": features}


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row_col (a long column of docs) if given, and the statistics of each row's whole text (null: empty). One row per row."""
    more = [row_col] if row_col else []

    def run(batch: pa.RecordBatch):
        ids = batch.column(0)
        for i, j, data, offs in C.pieces(batch.column(1)):
            x = document_stats(data, offs)
            f = x.pop("features")
            yield x | {c: batch.column(2).slice(i, j - i) for c in more} | {"doc_id": ids.slice(i, j - i), "features": pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * f.shape[1], pa.int32()), pa.array(f.ravel()))}

    return C.arrow_map(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col], *[docs[c] for c in more]), run, ", ".join(["doc_id long", *[f"{c} long" for c in more], SCHEMA]))
