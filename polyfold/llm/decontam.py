"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased (A-Z) word sequences. A test item occurs in a document if some run of the document's words
is within the item's error budget of word edits. If so, one of the budget + 1 pieces that the item is split into
stands there unchanged.

1. Items are cut into pieces. A bit table of fixed size, the only thing that is broadcast, tells which hashes
   pieces may have.
2. One pass over the documents hashes their word windows; documents with a possible hit are written with the hashes
   of their words and the places of the hits.
3. Hits are joined with pieces on the hash, so neither items nor documents are held on one machine, and a piece
   that many items share spreads over tasks.
4. Each document with its candidates is verified with Myers' bit-parallel distance around the hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyfold.llm import common as C

#: Bits of the table that tells which windows may be pieces (2 MB).
FILTER_BITS = 24
#: A longer piece counts as hit if its first words are, so window lengths are few.
PIECE_WORDS = 8
#: Shares that a document's candidates are verified in.
SHARES = 16


def word_hashes(text: str) -> np.ndarray:
    """Hashes of a text's words in lower case (A-Z)."""
    data = C.LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    starts, ends, _ = C.words(data, np.array([0, len(data)]))
    return C.string_hash(data, starts, ends)


def budget_of(words: int, share: float) -> int:
    return int(words * share)


def pieces_of(w: np.ndarray, share: float) -> tuple[int, np.ndarray, np.ndarray]:
    """For an item's words: the length of its windows, their hashes and their offsets in the item."""
    e = budget_of(len(w), share)
    cuts = [len(w) * i // (e + 1) for i in range(e + 2)]
    n = min(PIECE_WORDS, *(b - a for a, b in zip(cuts, cuts[1:])))
    return n, np.array([C.grams(w[a : a + n], n)[0] for a in cuts[:-1]], C.U64), np.array(cuts[:-1])


def best_match(pattern: int, masks: dict[int, int], text: list[int]) -> tuple[int, int]:
    """Myers' bit-parallel search: the least edit distance of the pattern (of so many words) to any run of the
    text, and the end of the first such run."""
    full, high = (1 << pattern) - 1, 1 << (pattern - 1)
    pv, mv, score = full, 0, pattern
    best, end = pattern, 0
    for i, word in enumerate(text):
        eq = masks.get(word, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score < best:
            best, end = score, i + 1
        ph <<= 1
        mh <<= 1
        pv = (mh | (~(xv | ph) & full)) & full
        mv = ph & xv & full
    return best, end


def masks_of(w: np.ndarray) -> dict[int, int]:
    """Words of an item as masks for best_match."""
    out: dict[int, int] = defaultdict(int)
    for i, x in enumerate(w.tolist()):
        out[x] |= 1 << i
    return dict(out)


def closest(item: np.ndarray, budget: int, begins: list[int], text: np.ndarray) -> tuple[int, int]:
    """The least distance of the item's words to a run of the text's, and the end of the first such run, searched
    around the places where the item may begin. Places that overlap are searched once: each allows the budget on both sides."""
    n, masks = len(item), masks_of(item)
    best, end, done, i = n + 1, 0, -1, 0
    begins = sorted(set(begins))
    while i < len(begins) and best:
        a, b = max(0, begins[i] - budget), begins[i] + n + budget
        while i + 1 < len(begins) and begins[i + 1] - budget <= b:
            i += 1
            b = begins[i] + n + budget
        i += 1
        a, b = max(a, done), min(b, len(text))
        got, at = best_match(n, masks, text[a:b].tolist())
        if got < best:
            best, end = got, a + at
    return best, end


def _pieces(items: DataFrame, share: float, least_words: int) -> DataFrame:
    """h, key, offset of all pieces of items (key, text); n: words in the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = word_hashes(text)
                if len(w) >= least_words:
                    n, h, at = pieces_of(w, share)
                    yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "key": pa.array(np.full(len(h), key)), "offset": pa.array(at, pa.int32()), "n": pa.array(np.full(len(h), n), pa.int32())})

    return items.mapInArrow(run, "h long, key long, offset int, n int")


def _hits(docs: DataFrame, lengths: list[int], table: np.ndarray) -> DataFrame:
    """doc_id, words (hashes of all words), h and pos (hits) of the documents that may hold a piece."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        bits = sent.value
        for i, j, data, offs in C.pieces(batch.column(1)):
            low = C.LOWER[data]
            starts, ends, first = C.words(low, offs)
            h = C.string_hash(low, starts, ends)
            doc = C.owner(first)
            found = []
            for n in lengths:
                if len(h) >= n:
                    g = C.grams(h, n)
                    slot = (g >> C.U64(64 - FILTER_BITS)).astype(np.int64)
                    at = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool) & (doc[: len(g)] == doc[n - 1 :]))
                    found.append((at, g[at]))
            at, g = (np.concatenate([x[c] for x in found] or [np.zeros(0, np.int64)]) for c in (0, 1))
            order = np.argsort(at, kind="stable")
            at, g = at[order], g[order].view(np.int64)
            some, begin = np.unique(doc[at], return_index=True)
            cut = list(zip(begin.tolist(), np.append(begin[1:], len(at)).tolist()))
            yield {
                "doc_id": batch.column(0).slice(i, j - i).take(pa.array(some)),
                "words": pa.array([h[first[d] : first[d + 1]].tobytes() for d in some], pa.binary()),
                "h": pa.array([g[a:b] for a, b in cut], pa.list_(pa.int64())),
                "pos": pa.array([(at[a:b] - first[d]).astype(np.int32) for d, (a, b) in zip(some, cut)], pa.list_(pa.int32())),
            }

    return C.arrow_map(docs, run, "doc_id long, words binary, h array<long>, pos array<int>")


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, least_words: int = 1, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, end_word: each document with each item found within floor(share * words) edits.

    Whole texts are searched, very long ones too. Items of fewer than 1 / share words are found unchanged only; items of fewer
    than least_words words, without words or null match nothing, and nothing matches in null or empty texts. Several
    occurrences count once, with the least distance (the first of those). Repeated document rows give one row, as
    do rows of one id with different texts, by their best; a null doc_id is an id like any other. Repeated items are one item;
    items without an id are found too, with item_id null. Either table empty: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    at = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    items = benchmark.select(benchmark[item_id_col].cast("long").alias("item_id"), benchmark[item_text_col].alias("text")).where("text is not null").distinct()
    items = C.written(items.withColumn("key", F.monotonically_increasing_id()), spark)
    pieces = C.written(_pieces(items.select("key", "text"), share, least_words), spark)
    # One bit for each slot and eight lengths at most reach the driver, whatever the number of items.
    lengths = sorted(r["n"] for r in pieces.select("n").distinct().collect())
    slots = pieces.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).cast("int").alias("s")).distinct().toArrow()["s"].to_numpy()
    table = np.zeros(1 << FILTER_BITS, bool)
    table[slots] = True
    hits = C.written(_hits(at, lengths, np.packbits(table, bitorder="little")).withColumn("row", F.monotonically_increasing_id()), spark)
    places = hits.select("row", F.explode(F.arrays_zip("h", "pos")).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.pos").alias("pos"))
    found = places.join(pieces.select("h", "key", "offset"), "h").groupBy("row", "key").agg(F.collect_set(F.col("pos") - F.col("offset")).alias("begins"))
    asked = found.join(items, "key").select("row", F.struct("key", "item_id", "text", "begins").alias("x")).groupBy("row", F.pmod("x.key", F.lit(SHARES)).alias("s")).agg(F.collect_list("x").alias("x"))
    both = asked.join(hits.select("row", "doc_id", "words"), "row").select("doc_id", "words", F.col("x.item_id").alias("item_id"), F.col("x.text").alias("text"), F.col("x.begins").alias("begins"))

    def verify(batch: pa.RecordBatch) -> Iterator[dict]:
        for r in range(batch.num_rows):
            words = np.frombuffer(batch.column("words")[r].as_buffer(), C.U64)
            out = []
            for item, text, begins in zip(*(batch.column(c)[r].as_py() for c in ("item_id", "text", "begins"))):
                w = word_hashes(text)
                budget = budget_of(len(w), share)
                distance, end = closest(w, budget, begins, words)
                if distance <= budget:
                    out.append((item, distance, end))
            yield {"doc_id": pa.array([batch.column("doc_id")[r].as_py()] * len(out), pa.int64())} | {c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("item_id", "distance", "end_word"))}

    out = C.arrow_map(both, verify, "doc_id long, item_id long, distance int, end_word long")
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end_word")).alias("m")).select("doc_id", "item_id", "m.distance", "m.end_word")


def judge(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Every row's doc_id, contaminated, items (sorted ids of test items found; those without id are not listed) and
    least distance (null: none). Rows that repeat an id are judged alike."""
    id_col = options.get("id_col", "doc_id")
    hits = contamination(docs, benchmark, **options).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.min("distance").alias("distance"))
    d = docs.select(docs[id_col].cast("long").alias("_id"))
    out = d.join(hits, F.col("_id").eqNullSafe(F.col("doc_id")), "left")
    none = F.array().cast("array<bigint>")
    return out.select(F.col("_id").alias("doc_id"), F.col("distance").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("items"), "distance")
