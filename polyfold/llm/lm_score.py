"""LM scoring: context-tree weighting over binary-decomposed bytes, beside a smoothed unigram of words.

Every bit of a byte has a binary context tree over the bytes before it. Each tree node keeps a Krichevsky-
Trofimov estimate, and a node's weighted probability is half its own estimate plus half the product of its
children's, so estimates of all depths are mixed by how well each explained the training bytes. A text's score
is the log10 probability of its bytes. The two shallow levels are broadcast, with a proven bound: 2**16 contexts
of 256 pairs of values (270 MB); only contexts seen in training are sent.

Deeper contexts have no such bound and stay distributed. Each chunk lists its distinct runs of depth + 1 bytes,
dealt by the three bytes before, so that a whole subtree below depth 2 meets in one group: its weighted
probabilities go up to the shallow levels as sums by two-byte context, and the mixed probability of every run
goes back to the chunks that have it.

Word counts have no such bound and are never broadcast. Documents are packed into chunks of a few MB, each with
its own list of distinct words; the counts of those words come back to the chunk by a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyfold.llm import common as C

#: Bytes of text whose words share a vocabulary list.
CHUNK_BYTES = 8 << 20
#: Bytes of text whose runs a group of subtrees holds on average.
GROUP_BYTES = 2 << 20


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0 (Stirling's series after shifting up by 8)."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _bit_counts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of 0 and 1 at the 255 bit nodes (1 to 255) from counts of bytes in the last axis."""
    t = np.zeros((*c.shape[:-1], 512))
    t[..., 256:] = c
    for j in (128, 64, 32, 16, 8, 4, 2, 1):
        t[..., j : 2 * j] = t[..., 2 * j : 4 * j : 2] + t[..., 2 * j + 1 : 4 * j : 2]
    return t[..., 0::2][..., :256], t[..., 1::2][..., :256]


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - np.log(np.pi)


_SMALL = np.arange(1 << 16)
_HALF, _ONE = log_gamma(_SMALL + 0.5), log_gamma(_SMALL + 1)


def _kt_of(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """_kt of whole counts, small ones by table."""
    n = n0 + n1
    at = np.minimum(n, len(_SMALL) - 1)
    out = _HALF[np.minimum(n0, at)] + _HALF[np.minimum(n1, at)] - _ONE[at] - np.log(np.pi)
    large = n >= len(_SMALL)
    out[large] = _kt(n0[large], n1[large])
    return out


def _byte_logs(p1: np.ndarray) -> np.ndarray:
    """log10 probabilities of the 256 bytes from those of a 1 at each bit node."""
    out = np.zeros((*p1.shape[:-1], 256))
    byte = np.arange(256)
    for level in range(8):
        node = (1 << level) | (byte >> (8 - level))
        bit = (byte >> (7 - level)) & 1
        p = p1[..., node]
        out += np.log10(np.where(bit == 1, p, 1 - p))
    return out


@dataclass
class ContextTree:
    """row: for each context of two bytes (older byte high) its row of table, log10 probabilities of the next byte.

    With deeper levels, table and rest have a value for each bit node instead: the probability of a 1 is
    table + rest * (what depth 3 gives).
    """

    row: np.ndarray
    table: np.ndarray
    rest: np.ndarray | None = None

    @classmethod
    def fit(cls, trigrams: np.ndarray, counts: np.ndarray, nodes: np.ndarray | None = None, sums: np.ndarray | None = None) -> ContextTree:
        """From counts of byte triples (older bytes high). Without any, all bytes are alike.

        nodes (context * 256 + bit node) and sums: logs of the weighted probabilities of depth 3, by depth 2.
        """
        context, byte = trigrams >> 8, trigrams & 255
        seen, at = np.unique(context, return_inverse=True)
        c2 = np.zeros((len(seen), 256))
        c2[at, byte] = counts
        last = seen & 255
        c1 = np.zeros((256, 256))
        np.add.at(c1, last, c2)
        weights, kts, product0 = [], [], np.zeros(256)
        n0, n1 = _bit_counts(c1)
        below = np.zeros((256, 256))
        deep = nodes is not None
        if deep:
            under = np.zeros((len(seen), 256))
            has = np.isin(nodes >> 8, seen)  # contexts outside training have sums of 0
            under[np.searchsorted(seen, nodes[has] >> 8), nodes[has] & 255] = sums[has]
        for i in range(0, len(seen), 4096):
            x = _kt(*_bit_counts(c2[i : i + 4096]))
            np.add.at(below, last[i : i + 4096], np.logaddexp(x, under[i : i + 4096]) + np.log(0.5) if deep else x)
        own = _kt(n0, n1)
        weighted = np.logaddexp(own, below) + np.log(0.5)
        w1 = np.exp(own + np.log(0.5) - weighted)
        p1 = (n1 + 0.5) / (n0 + n1 + 1)
        r0, r1 = _bit_counts(c1.sum(0))
        own0 = _kt(r0, r1)
        w0 = np.exp(own0 - np.logaddexp(own0, weighted.sum(0)))
        p0 = (r1 + 0.5) / (r0 + r1 + 1)
        table = np.empty((256 + len(seen), 256), np.float64 if deep else np.float32)
        rest = np.empty_like(table) if deep else None
        if deep:
            table[:256] = w0 * p0 + (1 - w0) * (w1 * p1 + (1 - w1) * 0.25)
            rest[:256] = (1 - w0) * (1 - w1) * 0.5
        else:
            table[:256] = _byte_logs(w0 * p0 + (1 - w0) * (w1 * p1 + (1 - w1) * 0.5))
        for i in range(0, len(seen), 4096):
            l = last[i : i + 4096]  # noqa: E741
            n0, n1 = _bit_counts(c2[i : i + 4096])
            p2 = (n1 + 0.5) / (n0 + n1 + 1)
            if deep:
                own = _kt(n0, n1)
                w2 = np.exp(own - np.logaddexp(own, under[i : i + 4096]))
                table[256 + i : 256 + i + len(l)] = w0 * p0 + (1 - w0) * (w1[l] * p1[l] + (1 - w1[l]) * w2 * p2)
                rest[256 + i : 256 + i + len(l)] = (1 - w0) * (1 - w1[l]) * (1 - w2)
            else:
                table[256 + i : 256 + i + len(l)] = _byte_logs(w0 * p0 + (1 - w0) * (w1[l] * p1[l] + (1 - w1[l]) * p2))
        row = (np.arange(65536) & 255).astype(np.int32)
        row[seen] = 256 + np.arange(len(seen))
        return cls(row, table, rest)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """log10 probability of each document's bytes."""
        t = triples(data, offs)
        logs = self.table[self.row[t >> 8], t & 255].astype(np.float64)
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        return sums[offs[1:]] - sums[offs[:-1]]


def triples(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each byte with the two before it; before a document's start stand zeros."""
    t = data.astype(np.int32)
    for back in (1, 2):
        prev = np.zeros(len(data), np.int32)
        prev[back:] = data[:-back] if len(data) > back else 0
        for k in range(back):
            at = offs[:-1] + k
            prev[at[at < offs[1:]]] = 0
        t |= prev << (8 * back)
    return t


def runs_of(data: np.ndarray, offs: np.ndarray, depth: int) -> np.ndarray:
    """Each byte (low) below the depth bytes before it, the nearest highest; before a document's start stand zeros."""
    t = data.astype(np.uint64)
    for back in range(1, depth + 1):
        prev = np.zeros(len(data), np.uint64)
        prev[back:] = data[:-back] if len(data) > back else 0
        for k in range(back):
            at = offs[:-1] + k
            prev[at[at < offs[1:]]] = 0
        t |= prev << C.U64(8 * (depth - back + 1))
    return t


def group_of(keys: np.ndarray, depth: int, groups: int) -> np.ndarray:
    """The group that holds a run's subtree: by the three bytes before."""
    return (C.mix(keys >> C.U64(8 * (depth - 2))) % C.U64(groups)).astype(np.int64)


def subtrees(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels 3 to depth over sorted distinct runs and their training counts.

    Returns the probability of a 1 that depth 3 gives at each run's eight bit nodes, and nodes and sums as
    ContextTree.fit takes them.
    """
    levels = []
    for d in range(3, depth + 1):
        u, at = np.unique(keys >> C.U64(8 * (depth - d + 1)) << C.U64(8) | keys & C.U64(255), return_inverse=True)
        levels.append((d, u, at, np.bincount(at, weights=counts, minlength=len(u)).astype(np.int64)))
    p = np.empty((8, len(keys)))
    nodes, sums = [], []
    for bit in range(8):
        chain, weighted, rep = [], None, None
        for d, u, at, c in reversed(levels):
            node = u >> C.U64(8 - bit)
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            n1, n = np.add.reduceat(c * (u >> C.U64(7 - bit) & C.U64(1)).astype(np.int64), first), np.add.reduceat(c, first)
            mine = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(u))))[at]
            own = _kt_of(n - n1, n1)
            w = np.ones(len(first))
            if d < depth:
                below = np.bincount(mine[rep], weights=weighted, minlength=len(first))
                weighted = np.logaddexp(own, below) + np.log(0.5)
                w = np.exp(own + np.log(0.5) - weighted)
            else:
                weighted = own
            chain.append((mine, w, (n1 + 0.5) / (n + 1)))
            rep = np.empty(len(first), np.int64)
            rep[mine] = np.arange(len(mine))
        out = 0.0
        for mine, w, one in chain:
            out = w[mine] * one[mine] + (1 - w[mine]) * out
        p[bit] = out
        x = _context(keys[rep], depth) << 8 | _bit_node(keys[rep], bit)
        some, at = np.unique(x, return_inverse=True)
        nodes.append(some)
        sums.append(np.bincount(at, weights=weighted, minlength=len(some)))
    return p, np.concatenate(nodes), np.concatenate(sums)


def _context(keys: np.ndarray, depth: int) -> np.ndarray:
    """The two bytes before, the older one high."""
    near = (keys >> C.U64(8 * depth)).astype(np.int64)
    return ((keys >> C.U64(8 * (depth - 1))).astype(np.int64) & 255) << 8 | near


def _bit_node(keys: np.ndarray, bit: int) -> np.ndarray:
    return 1 << bit | (keys & C.U64(255)).astype(np.int64) >> 8 - bit


def run_logs(tree: ContextTree, keys: np.ndarray, p: np.ndarray, depth: int) -> np.ndarray:
    """log10 probabilities of the runs' last bytes, with p of subtrees."""
    row, out = tree.row[_context(keys, depth)], np.zeros(len(keys))
    for bit in range(8):
        node = _bit_node(keys, bit)
        one = tree.table[row, node] + tree.rest[row, node] * p[bit]
        out += np.log10(np.where(keys >> C.U64(7 - bit) & C.U64(1), one, 1 - one))
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and each entry's place among them."""
    u, at = np.unique(x, return_inverse=True)
    return u, at.astype(np.int32)


def _union(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]))


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of x: first holds where each begins, and the end of the last."""
    total = np.concatenate([[0.0], np.cumsum(x)])
    return total[first[1:]] - total[first[:-1]]


def packed(docs: DataFrame) -> DataFrame:
    """Chunks of documents (doc_id, text, train): the distinct words, and triples with training counts, and the texts."""

    def run(batches):
        held: list = []
        size, chunk = 0, TaskContext.get().partitionId() << 32

        def flush():
            nonlocal held, size, chunk
            vocab, counts = _summed([x["vocab"] for x in held], [x["counts"] for x in held])
            tri, tri_n = _summed([x["tri"] for x in held], [x["tri_n"] for x in held])
            one = {"chunk": [chunk], "vocab": [vocab.tobytes()], "counts": [counts.tobytes()], "doc_ids": [pa.concat_arrays([x["ids"] for x in held]).to_pylist()], "bytes": [np.concatenate([x["bytes"] for x in held]).tolist()], "text": [b"".join(x["text"] for x in held)], "train": [np.concatenate([x["train"] for x in held]).tolist()], "trained": [sum(int(x["train"].sum()) for x in held)], "tri": [tri.astype(np.int32).tobytes()], "tri_n": [tri_n.tobytes()]}
            held, size, chunk = [], 0, chunk + 1
            return pa.RecordBatch.from_pydict(one, schema=want)

        for batch in batches:
            for i, j, data, offs in C.pieces(batch.column(1)):
                low = C.LOWER[data]
                starts, ends, first = C.words(low, offs)
                train = batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False)
                h = C.string_hash(low, starts, ends)
                vocab, at = np.unique(h, return_inverse=True)
                counts = np.bincount(at, weights=np.repeat(train, np.diff(first)), minlength=len(vocab)).astype(np.int64)
                tri, tri_n = np.unique(triples(data, offs)[np.repeat(train, np.diff(offs))], return_counts=True)
                held.append({"ids": batch.column(0).slice(i, j - i), "vocab": vocab, "counts": counts, "bytes": np.diff(offs), "text": data.tobytes(), "train": train, "tri": tri, "tri_n": tri_n})
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield flush()
        if held:
            yield flush()

    schema = "chunk long, vocab binary, counts binary, doc_ids array<long>, bytes array<long>, text binary, train array<boolean>, trained long, tri binary, tri_n binary"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    want = to_arrow_schema(_parse_datatype_string(schema))
    return docs.mapInArrow(run, schema)


def _unpack(key: str, value: str, kind: type, schema: str):
    """Rows from two binary columns of chunks."""

    def run(batch: pa.RecordBatch):
        for c, k, v in zip(batch.column("chunk").to_pylist(), batch.column(key), batch.column(value)):
            k, v = np.frombuffer(k.as_buffer(), kind), np.frombuffer(v.as_buffer(), np.int64)
            for i in range(0, len(k), 1 << 17):
                yield {"chunk": np.full(len(k[i : i + (1 << 17)]), c), "k": k[i : i + (1 << 17)].view(np.int64 if kind is np.uint64 else kind), "c": v[i : i + (1 << 17)], "i": np.arange(i, min(i + (1 << 17), len(k)), dtype=np.int32)}

    return lambda df: C.arrow_map(df.select("chunk", key, value), run, schema)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: small numbers compress well."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _whole(x: pa.Scalar, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _texts(text: pa.Scalar, size: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), text.as_buffer())


def _dealt(chunks: DataFrame, depth: int, groups: int) -> DataFrame:
    """group, chunk, runs, runs_n: each chunk's distinct runs (steps between sorted ones) and training counts by group."""

    def run(batch: pa.RecordBatch):
        for n, c in enumerate(batch.column("chunk").to_pylist()):
            size, train = np.array(batch.column("bytes")[n].as_py(), np.int64), np.array(batch.column("train")[n].as_py(), bool)
            ks, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, j, data, o in C.pieces(_texts(batch.column("text")[n], size)):
                if len(data):
                    r = np.sort(runs_of(data, o, depth) << C.U64(1) | np.repeat(train[i:j], np.diff(o)).astype(np.uint64))
                    at = np.flatnonzero(np.concatenate([[True], r[1:] >> C.U64(1) != r[:-1] >> C.U64(1)]))
                    ks.append(r[at] >> C.U64(1))
                    vs.append(np.add.reduceat((r & C.U64(1)).astype(np.int64), at))
            k, v = _summed(ks, vs)
            v = v.astype(np.uint32)
            g = group_of(k, depth, groups)
            order = np.argsort(g, kind="stable")
            at = np.flatnonzero(np.diff(g[order], prepend=-1))
            ends = np.append(at, len(k))[1:]
            for i in range(0, len(at), 1024):
                parts = [order[x:y] for x, y in zip(at[i : i + 1024], ends[i : i + 1024])]
                yield {"group": g[order[at[i : i + 1024]]], "chunk": np.full(len(parts), c), "runs": pa.array([_planes(np.diff(k[x], prepend=C.U64(0))) for x in parts], pa.binary()), "runs_n": pa.array([_planes(v[x]) for x in parts], pa.binary())}

    return C.arrow_map(chunks.select("chunk", "bytes", "train", "text"), run, "group long, chunk long, runs binary, runs_n binary")


def _group(runs: pa.Array, runs_n: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The runs of each chunk of a group, and all its distinct runs with their training counts."""
    each = [np.cumsum(_whole(x, np.uint64), dtype=np.uint64) for x in runs]
    return each, *_summed(each, [_whole(x, np.uint32) for x in runs_n])


def score_documents(docs: DataFrame, fold: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text", depth: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    Rows outside the held-out fold train. depth: bytes of the longest context, 2 to 6. Null and empty texts have
    one token, the end, and score 0 with null bits_per_byte; very long texts are scored whole. Repeated rows count as
    often as they stand and get equal results; a null id is the empty text in folds. Without training rows every word
    is unknown, train_tokens is 0 and base_score is the sum's limit, log10(0.5 / 0.5) = 0. An empty table gives an
    empty table. Other columns, whatever their names, are not read.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    spark = docs.sparkSession
    at = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    at = at.withColumn("train", C.crc_fold("doc_id", fold) != held)
    chunks = C.written(packed(at), spark, wide=4)
    # Words: totals over all chunks, and back to each chunk the totals of its own words.
    listed = _unpack("vocab", "counts", np.uint64, "chunk long, k long, i int, c long")(chunks)
    totals = C.written(listed.where("c > 0").groupBy("k").agg(F.sum("c").alias("total")), spark)
    sums = totals.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    trained, size = chunks.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum(F.aggregate("bytes", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0))).first()
    n_all, v_all = sums[0] + trained, sums[1] + (trained > 0)
    norm = n_all + 0.5 * (v_all + 1)
    back = listed.select("chunk", "k", "i").join(totals, "k").select("chunk", "i", "total")

    def known(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: one chunk; right: totals of its words, by their places in its list."""
        if not left.num_rows:
            return want_words.empty_table()
        x = {c: left[c][0] for c in left.column_names}
        words = []
        for _, _, data, o in C.pieces(_texts(x["text"], np.array(x["bytes"].as_py(), np.int64))):
            low = C.LOWER[data]
            starts, ends, at = C.words(low, o)
            words.append((*_ranked(C.string_hash(low, starts, ends)), at))
        vocab = _union([u for u, _, _ in words])  # as packed() made it
        counts = np.zeros(len(vocab), np.int64)
        counts[right["i"].to_numpy()] = right["total"].to_numpy()
        end = np.log10((trained + 0.5) / norm)
        logs, seen, n, base, hits = np.log10((counts + 0.5) / norm), counts > 0, [], [], []
        for u, at, o in words:
            place = np.searchsorted(vocab, u)
            n.append(np.diff(o) + 1)
            base.append(_sums(logs[place][at], o) + end)
            hits.append(_sums(seen[place][at], o).astype(np.int64) + (trained > 0))
        return pa.table({"chunk": [x["chunk"].as_py()], **{c: [np.concatenate(y).tolist()] for c, y in (("n", n), ("known", hits), ("base", base))}}, schema=want_words)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = "chunk long, n array<long>, known array<long>, base array<double>"
    want_words = to_arrow_schema(_parse_datatype_string(schema))
    tasks = max(1, -(-size // CHUNK_BYTES))  # about a chunk each, whatever the input
    by_chunk = lambda d: d.repartition(tasks, "chunk").groupBy("chunk")
    back = C.written(by_chunk(chunks.select("chunk", "bytes", "text")).cogroup(by_chunk(back)).applyInArrow(known, schema), spark, wide=4)
    C.discard(totals)
    back = back.select("*", F.lit(None).cast("long").alias("group"), F.lit(None).cast("binary").alias("logs"))
    # Bytes: at most 2**24 triples and as many bit nodes reach the driver.
    tri = _unpack("tri", "tri_n", np.int32, "chunk long, k int, i int, c long")(chunks).groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    groups = -(-size // GROUP_BYTES) if depth > 2 else 0
    nodes = None
    if groups:

        def weigh(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            _, nodes, sums = subtrees(*_group(t["runs"], t["runs_n"])[1:], depth)
            return pa.table({"group": [t["group"][0].as_py()], "chunks": [t["chunk"].to_pylist()], "runs": [t["runs"].to_pylist()], "runs_n": [t["runs_n"].to_pylist()], "node": [nodes.tobytes()], "sum": [sums.tobytes()]})

        trees = C.written(_dealt(chunks, depth, groups).groupBy("group").applyInArrow(weigh, "group long, chunks array<long>, runs array<binary>, runs_n array<binary>, node binary, sum binary"), spark, wide=4)

        def unpacked(batch: pa.RecordBatch):
            for k, v in zip(batch.column("node"), batch.column("sum")):
                yield {"node": np.frombuffer(k.as_buffer(), np.int64), "sum": np.frombuffer(v.as_buffer(), np.float64)}

        nodes = C.arrow_map(trees.select("node", "sum"), unpacked, "node long, sum double").groupBy("node").agg(F.sum("sum").alias("sum")).toArrow()
    sent = spark.sparkContext.broadcast(ContextTree.fit(tri["k"].to_numpy(), tri["c"].to_numpy(), *([] if nodes is None else [nodes["node"].to_numpy(), nodes["sum"].to_numpy()])))
    if groups:

        def mixed(batch: pa.RecordBatch):
            for n, group in enumerate(batch.column("group").to_pylist()):
                chunk = batch.column("chunks")[n].as_py()
                runs, keys, counts = _group(batch.column("runs")[n].values, batch.column("runs_n")[n].values)
                logs = run_logs(sent.value, keys, subtrees(keys, counts, depth)[0], depth).astype(np.float32)
                yield {"chunk": chunk, "group": [group] * len(chunk), "logs": pa.array([_planes(logs[np.searchsorted(keys, x)]) for x in runs], pa.binary())}

        got = C.written(C.arrow_map(trees.select("group", "chunks", "runs", "runs_n"), mixed, "chunk long, group long, logs binary"), spark, wide=1000)
        C.discard(trees)
        back = back.unionByName(got, allowMissingColumns=True)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: one chunk; right: what known() gave of it, and logs of its runs by groups."""
        if not left.num_rows:
            return want.empty_table()
        x = {c: left[c][0] for c in left.column_names}
        size = np.array(x["bytes"].as_py(), np.int64)
        runs, first = [], []
        for _, _, data, o in C.pieces(_texts(x["text"], size)):
            if groups:
                runs.append((*_ranked(runs_of(data, o, depth)), o))
            else:
                first.append(sent.value.score(data, o))
        if groups:
            keys = _union([u for u, _, _ in runs])  # as _dealt() made it
            deep = right.filter(pc.is_valid(right["group"])).sort_by("group")
            logs = np.empty(len(keys))
            logs[np.argsort(group_of(keys, depth, groups), kind="stable")] = np.concatenate([_whole(b, np.float32) for b in deep["logs"]]) if deep.num_rows else 0.0
            while runs:
                u, at, o = runs.pop(0)
                first.append(_sums(logs[np.searchsorted(keys, u)][at], o))
        words = right.filter(pc.is_valid(right["n"]))
        n, hits, base = (words[c][0].values for c in ("n", "known", "base"))
        return pa.table([pa.array(x["doc_ids"].as_py(), pa.int64()), n, hits, base, pa.array(np.concatenate(first)), pa.array(size)], schema=want)

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, bytes long"
    want = to_arrow_schema(_parse_datatype_string(schema))
    left = chunks.select("chunk", "doc_ids", "bytes", "text")
    out = by_chunk(left).cogroup(by_chunk(back)).applyInArrow(scored, schema)
    bits = F.when(F.col("bytes") > 0, -F.col("score") * F.lit(float(np.log2(10))) / F.col("bytes"))
    return out.select("doc_id", (C.crc_fold("doc_id", fold) == held).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
