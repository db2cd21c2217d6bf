"""Exact repeats by distributed prefix doubling over sampled positions.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Full prefix doubling sorts a
rank pair for every byte of the corpus in every round, some hundred times the input. The same is found
from fewer positions:

* Among the ANCHOR-byte strings of a window of `length` bytes, the one with the smallest hash (the leftmost of
  equals) is the window's anchor. Equal windows have their anchors at equal offsets. Consecutive windows
  share anchors, so a text has an anchor about every 70 bytes; its windows' starts are a run of at most
  length - ANCHOR + 1 positions, and the union of the run's first and last window covers what all of them do.
* Round 1 ranks anchors by their ANCHOR bytes; positions of a rank that is found once are dropped, for no window
  over them is repeated.
* Round 2 pairs that rank with the rank of the whole run (the bytes from its first window's start to its
  last window's end). A pair found twice settles all of the run's windows as repeated.
* Round 3 is for the rest, the edges of repeats: runs whose anchor is found elsewhere in other surroundings. One
  occurrence of each pair is laid out position by position, and these are doubled: pairs of the ranks at a
  position and at an offset from it are sorted, which ranks twice as many bytes, and positions of a rank that is
  found once are dropped, until the ranks cover the full length (64, 128 and 200 bytes).

A rank is a hash of the pair that it names, so it can be told anywhere without looking it up, and sorting only
finds which ones are found twice; the order of suffixes is never asked for. Texts that are equal as a whole are
one text from the start: when there are two or more, every window is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyfold.llm import common as C

ANCHOR = 64
#: Round 3 doubles the positions around an anchor's rank within one task up to so many occurrences; above, the rounds
#: are shuffles of positions, so that no rank is held by one task.
GROUP = 20_000


def anchor_runs(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, anchor, first window, last window, rank of the anchor, rank of the run) of each run of windows."""
    empty = np.zeros(0, np.int64)
    n_windows = len(data) - length + 1
    if n_windows < 1:
        return (empty,) * 4 + (empty.astype(C.U64),) * 2
    s = C.prefix(data)
    n = len(data) - ANCHOR + 1
    g = C.window_hash(s, ANCHOR)
    w = length - ANCHOR + 1
    key = (g & C.U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=C.U64)
    # Minima of w keys from each position on, by running minima within blocks of w from both ends.
    pad = -n % w
    blocks = np.concatenate([key, np.full(pad, 2**64 - 1, C.U64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:n_windows], ahead[w - 1 : w - 1 + n_windows]) & C.U64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n_windows, bool)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        inside[a : max(a, b - length + 1)] = True
    new = np.ones(n_windows, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return (empty,) * 4 + (empty.astype(C.U64),) * 2
    end = np.ones(n_windows, bool)
    end[:-1] = new[1:] | ~inside[1:]
    last = np.flatnonzero(end & inside)
    a = anchor[first]
    doc = np.searchsorted(offs, first, "right") - 1
    return doc, a, first, last, g[a], C.span_hash(s, first, last + length)


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """Rows of (tid, many, text): rank, run, tid, many, at (anchor in the text, and how far windows reach before it)."""

    def run(batch: pa.RecordBatch):
        for i, j, data, offs in C.pieces(batch.column(2)):
            doc, a, first, last, rank, whole = anchor_runs(data, offs, length)
            tid = batch.column(0).slice(i, j - i).to_numpy()[doc]
            many = batch.column(1).slice(i, j - i).to_numpy(zero_copy_only=False)[doc]
            at = ((a - offs[doc]) << 32) | ((a - first) << 16) | (a - last)
            yield {"rank": rank.view(np.int64), "run": whole.view(np.int64), "tid": tid, "many": many, "at": at}

    return C.arrow_map(texts, run, "rank long, run long, tid long, many boolean, at long")


def _spans(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of packed runs."""
    a = at >> 32
    return a - ((at >> 16) & 0xFFFF), a - (at & 0xFFFF)


def _surroundings(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of runs: rank, k, tid, at, ask, bytes."""
    per_text = wanted.groupBy("tid").agg(F.collect_list(F.struct("rank", "k", "at", "ask")).alias("w"))
    both = per_text.join(texts.select("tid", "text"), "tid").select("tid", "text", F.col("w.rank").alias("rank"), F.col("w.k").alias("k"), F.col("w.at").alias("at"), F.col("w.ask").alias("ask"))

    def run(batch: pa.RecordBatch):
        for r in range(batch.num_rows):
            text = batch.column("text")[r].as_buffer()
            x = {c: batch.column(c)[r].values for c in ("rank", "k", "at", "ask")}
            first, last = _spans(x["at"].to_numpy())
            yield x | {"tid": np.full(len(first), batch.column("tid")[r].as_py()), "bytes": pa.array([text[a : b + length].to_pybytes() for a, b in zip(first.tolist(), last.tolist())], pa.binary())}

    return C.arrow_map(both, run, "rank long, k long, tid long, at long, ask boolean, bytes binary")


def offsets(length: int) -> list[int]:
    """Offsets of the rounds that lead from ranks of ANCHOR bytes to ranks of length bytes."""
    out, n = [], ANCHOR
    while n < length:
        out.append(min(n, length - n))
        n += out[-1]
    return out


def _starts(t: pa.Table | pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows of the rows' bytes, piece by piece: row, offset in the row, place in the piece; and the piece's ranks:
    for each step those of all places at so many bytes."""
    x = t["bytes"].combine_chunks() if isinstance(t, pa.Table) else t["bytes"]
    for i, _, data, offs in C.pieces(x.view(pa.string())):
        n = np.maximum(np.diff(offs) - length + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ranks = [C.window_hash(C.prefix(data), ANCHOR)]
        for step in offsets(length):
            r = ranks[-1]
            ranks.append(C.grams(r, 2) if step == 1 else C.mix(r[: len(r) - step] * C.U64(0x9E3779B97F4A7C15) + r[step:] + C.U64(step)))
        yield row + i, off, offs[row] + off, ranks


def twice(x: np.ndarray) -> np.ndarray:
    """Which entries are found again: x is sorted and neighbours are compared."""
    order = np.argsort(x)
    same = x[order[1:]] == x[order[:-1]]
    out = np.zeros(len(x), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _edges(around: DataFrame, length: int) -> DataFrame:
    """Round 3: tid, a, b — for each asked run with a repeated window, from the first such window to the last one's end.

    A run's windows all hold its anchor, so the repeated ones overlap.
    """
    cols = ["rank", "tid", "at", "ask", "bytes"]
    small = around.where(F.col("k") <= GROUP).select(*cols).repartition("rank").sortWithinPartitions("rank")
    rounds = range(len(offsets(length)) + 1)

    def in_groups(batches):
        for t in C.runs(batches, ["rank"]):
            parts = list(_starts(t, length))
            row, off = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
            seed = C.mix(t["rank"].combine_chunks().to_numpy().view(C.U64))[row]
            left = np.arange(len(row))
            for k in rounds:
                # Ranks of this round for the positions that are left; equal ones under other anchors are not meant.
                rank = np.concatenate([p[3][k][p[2]] for p in parts])[left]
                left = left[twice(C.mix(rank ^ seed[left]))]
            ask = t["ask"].combine_chunks().to_numpy(zero_copy_only=False)
            hit = left[ask[row[left]]]
            if len(hit):
                r, at = np.unique(row[hit], return_index=True)
                last = np.append(at[1:], len(hit)) - 1
                first, _ = _spans(t["at"].combine_chunks().to_numpy()[r])
                yield pa.RecordBatch.from_pydict({"tid": t["tid"].combine_chunks().take(pa.array(r)), "a": pa.array(first + off[hit[at]]), "b": pa.array(first + off[hit[last]] + length)})

    def by_rows(batch: pa.RecordBatch):
        first, _ = _spans(batch["at"].to_numpy())
        seed = C.mix(batch["rank"].to_numpy().view(C.U64))
        for row, off, place, ranks in _starts(batch, length):
            yield {f"r{k}": C.mix(ranks[k][place] ^ seed[row]).view(np.int64) for k in rounds} | {c: batch[c].take(pa.array(row)) for c in ("tid", "at", "ask")} | {"p": first[row] + off}

    out = small.mapInArrow(in_groups, "tid long, a long, b long")
    if around.where(F.col("k") > GROUP).isEmpty():
        return out
    large = C.arrow_map(around.where(F.col("k") > GROUP).select(*cols), by_rows, ", ".join(f"r{k} long" for k in rounds) + ", tid long, at long, ask boolean, p long")
    for k in rounds:
        # Counted before the shuffle, so a hot rank costs one row a task.
        found = large.groupBy(f"r{k}").agg(F.count("*").alias("c")).where("c > 1").select(f"r{k}")
        before, large = large, C.written(large.join(found, f"r{k}").drop(f"r{k}"), around.sparkSession)
        C.discard(before)
    large = large.where("ask").groupBy("tid", "at").agg(F.min("p").alias("a"), (F.max("p") + length).alias("b")).select("tid", "a", "b")
    return out.union(large)


def _cut(spans: DataFrame, texts: DataFrame, with_text: bool) -> DataFrame:
    """k1, k2, n_removed, n_spans, kept_sha256 (and kept) of texts from the spans (tid, a, b) to remove."""
    per_text = spans.groupBy("tid").agg(F.collect_set(F.struct("a", "b")).alias("s"))
    both = per_text.join(texts.select("tid", "k1", "k2", "text"), "tid").select("k1", "k2", "text", F.col("s.a").alias("a"), F.col("s.b").alias("b"))

    def run(batch: pa.RecordBatch):
        out = {"n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for r in range(batch.num_rows):
            text = batch.column("text")[r].as_buffer()
            a, b = (batch.column(c)[r].values.to_numpy() for c in ("a", "b"))
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            head = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            start, stop = a[head], b[np.append(head[1:], len(a)) - 1]
            kept = b"".join(text[x:y].to_pybytes() for x, y in zip(np.append(0, stop).tolist(), np.append(start, len(text)).tolist()))
            out["n_removed"].append(int((stop - start).sum()))
            out["n_spans"].append(len(head))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept if with_text else None)
        yield out | {"k1": batch.column("k1"), "k2": batch.column("k2")}

    return C.arrow_map(both, run, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeated_bytes(docs: DataFrame, length: int = 200, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with_text adds kept (the remaining bytes).

    Texts are UTF-8 bytes, null is empty. Strings never cross documents; overlapping occurrences count, and all
    are judged on the input. Texts shorter than length lose nothing; very long ones are judged whole. Repeated rows are
    documents of their own, so they repeat each other; null ids are kept as they are. An empty table gives an empty
    table. Other columns, whatever their names, are not read.
    """
    if length <= ANCHOR or length - ANCHOR >= 0xFFFF:
        raise ValueError(f"length must be over {ANCHOR}")
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    keys = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), *keys)
    long_ones = rows.where(F.octet_length("text") >= length)
    texts = long_ones.groupBy("k1", "k2").agg(F.first("text").alias("text"), (F.count("*") > 1).alias("many"))
    texts = C.written(texts.withColumn("tid", F.monotonically_increasing_id()), spark)
    anchors = C.written(_anchors(texts.select("tid", "many", "text"), length), spark)
    # Rounds 1 and 2. A hot pair is counted before its shuffle; ranks meet in a window that can spill.
    pairs = anchors.groupBy("rank", "run").agg(F.count("*").alias("c"))
    one = Window.partitionBy("rank")
    ranks = pairs.withColumn("all", F.sum("c").over(one)).withColumn("k", F.count("*").over(one)).withColumn("edge", F.min("c").over(one) == 1).where("all > 1")
    ranks = C.written(ranks.select(F.col("rank").alias("r"), F.col("run").alias("u"), (F.col("c") > 1).alias("settled"), "k", "edge"), spark)
    found = anchors.join(ranks, (F.col("rank") == F.col("r")) & (F.col("run") == F.col("u"))).where("edge or not many").select("rank", "run", "tid", "many", "at", "settled", "k", "edge")
    found = C.written(found, spark)
    C.discard(anchors, ranks)
    # Round 3: what is asked, and one occurrence of each settled pair to compare with.
    partners = found.where("edge and settled").dropDuplicates(["rank", "run"]).withColumn("ask", F.lit(False))
    asked = found.where("edge and not settled").withColumn("ask", ~F.col("many"))
    wanted = asked.union(partners).select("rank", "k", "tid", "at", "ask")
    around = C.written(_surroundings(wanted, texts, length), spark)
    edges = C.written(_edges(around, length), spark)
    C.discard(around)
    a = F.shiftright("at", 32)
    settled = found.where("settled and not many").select("tid", (a - F.shiftright("at", 16).bitwiseAND(0xFFFF)).alias("a"), (a - F.col("at").bitwiseAND(0xFFFF) + length).alias("b"))
    cut = _cut(settled.union(edges), texts, with_text)
    if not with_text:
        cut = cut.drop("kept")
    cut = C.written(cut, spark)
    C.discard(found, edges)
    whole = texts.where("many").select("k1", "k2", F.lit(-1).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), *([F.lit(b"").alias("kept")] if with_text else []))
    decided = C.written(cut.union(whole), spark)
    C.discard(cut, texts)
    n = F.octet_length("text").cast("long")
    mine = rows.select("doc_id", "k1", "k2", n.alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), *([F.col("text").cast("binary").alias("text")] if with_text else []))
    out = mine.join(decided, ["k1", "k2"], "left")
    removed = F.when(F.col("n_removed") < 0, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    cols = [F.col("doc_id"), F.col("n_bytes"), removed.alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return out.select(*cols, *([F.coalesce("kept", "text").alias("kept")] if with_text else []))
