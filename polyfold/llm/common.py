"""Shared parts: whole-text byte kernels over Arrow batches, scratch tables, connected components.

Texts reach the kernels as Arrow buffers and are worked on as numpy byte arrays, several
documents at a time, without building Python strings. Nulls count as empty texts.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Rows that reach Python at once where texts do.
ROWS_PER_BATCH = 2000
#: Bytes of wide rows in an Arrow batch; in a row group (compressed).
WIDE_BYTES = 8 << 20
WIDE = {"parquet.block.size": 2 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: Bytes of text handled at once; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20
#: Span hashes are polynomials modulo the Mersenne prime 2**31 - 1, at two random points (LANES): modulo a power of two
#: any odd point makes some pairs of strings collide (Thue-Morse words).
PRIME, LANES = U64(2**31 - 1), 2
#: Numbers that kernels work on at a time, to stay in the processor's cache.
CACHED = 1 << 13
_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**31 - 1, (LANES, 256), dtype=np.uint64)
POINT = [int(x) for x in _rng.integers(2**20, 2**31 - 1, LANES)]
_POW = _INV = np.ones((LANES, 1), np.uint32)
#: Separators of words: space and bytes 9 to 13.
IS_SEP = np.zeros(256, bool)
IS_SEP[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _fold(x: np.ndarray) -> np.ndarray:
    """x, in place, made smaller without changing it modulo PRIME."""
    high = x >> U64(31)
    x &= PRIME
    x += high
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the points and of their inverses modulo PRIME, at least n of each."""
    global _POW, _INV
    if _POW.shape[1] < n:
        n = max(n, PIECE_BYTES + 1)
        for name, sign in (("_POW", 1), ("_INV", -1)):
            x = np.ones((LANES, n), U64)
            for k, point in enumerate(POINT):
                m = 1
                while m < n:
                    step = U64(pow(point, sign * m, int(PRIME)))
                    x[k, m : 2 * m] = _fold(_fold(x[k, : min(m, n - m)] * step))
                    m *= 2
            globals()[name] = x.astype(np.uint32)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash, one row a lane; span_hash reads any span off them. For up to 2**31 bytes."""
    pw, n = powers(len(data) + 1)[0], len(data)
    s = np.zeros((LANES, n + 1), U64)
    for k in range(LANES):
        for i in range(0, n, CACHED):
            x = BYTE_CODE[k].take(data[i : i + CACHED])
            x *= pw[k, i : i + len(x)]
            _fold(x)
            x[0] += s[k, i]
            np.cumsum(x, out=s[k, i + 1 : i + 1 + len(x)])
    return s


def _hashed(n: int, part: Callable[[int, slice], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """n hashes; part gives differences of prefix sums and inverse powers for a lane and a slice of the hashes."""
    out = np.empty(n, U64)
    for i in range(0, n, CACHED):
        at = slice(i, min(i + CACHED, n))
        for k in range(LANES):
            x, inverse = part(k, at)
            _fold(_fold(x))
            x *= inverse
            _fold(_fold(x))
            x -= PRIME * (x >= PRIME)
            if k:
                x <<= U64(31 * k)
                out[at] |= x
            else:
                out[at] = x
        out[at] = mix(out[at])
    return out


def span_hash(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """62-bit hashes of the bytes from a to b; equal bytes have equal hashes wherever they stand.

    Two strings of n bytes, chosen without knowing the points, collide with a probability of at most (n / 2**31)**2.
    """
    inverse = powers(s.shape[1])[1]
    return _hashed(len(a), lambda k, at: (s[k].take(b[at]) - s[k].take(a[at]), inverse[k].take(a[at])))


def window_hash(s: np.ndarray, n: int) -> np.ndarray:
    """The same for all spans of n bytes, by their starts."""
    inverse = powers(s.shape[1])[1]
    return _hashed(max(s.shape[1] - n, 0), lambda k, at: (s[k, at.start + n : at.stop + n] - s[k, at], inverse[k, at]))


#: The lowest bytes of a number, by how many.
_LOWEST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: Strings longer than this are hashed one by one.
LONG = 1024


def string_hash(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings from a to b, for short ones such as words: eight bytes a step, mixed in one after another.

    Every step is a bijection of the bytes that it takes, and lengths count, so strings of up to eight bytes only
    collide across lengths, by chance.
    """
    at = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    left = b - a
    out = left.astype(U64) * U64(0x9E3779B97F4A7C15)
    todo, pos = None, a
    while len(pos):
        x = at[pos]
        x &= _LOWEST.take(np.minimum(left, 8))
        if todo is None:
            x += out
            out = mix(x)
        else:
            x += out[todo] * U64(0xD6E8FEB86659FD93)
            out[todo] = mix(x)
        more = np.flatnonzero((left > 8) & (left <= LONG))
        todo = more if todo is None else todo[more]
        pos, left = pos[more] + 8, left[more] - 8
    for i in np.flatnonzero(b - a > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[a[i] : b[i]], digest_size=8).digest(), "little")
    return out


def pieces(texts: pa.Array, limit: int = PIECE_BYTES, rows: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with their bytes and offsets: (first row, end row, bytes, offsets)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), i + rows, len(texts))
        yield i, j, whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each document (one more entry than documents)."""
    n = len(data)
    sep = IS_SEP[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = sep[:-1]
    edge[offs] = True
    starts = np.flatnonzero(edge[:n] & ~sep)
    last = np.ones(n + 1, bool)
    last[1:n] = sep[1:]
    last[offs] = True
    ends = np.flatnonzero(last[1:] & ~sep) + 1
    return starts, ends, np.searchsorted(starts, offs)


def owner(first: np.ndarray) -> np.ndarray:
    """The document of each item, where first holds each document's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k items from each position on (shorter by k - 1)."""
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i] + U64(i))
    return out


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with fn from a batch to dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    want = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cols in fn(batch):
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x := cols[f.name], pa.Array) else pa.array(x, f.type) for f in want], schema=want)

    return df.mapInArrow(run, schema)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that columns have already (in either case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def crc_fold(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="polyfold-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Tables of written() that are still there: path, session and the thread that wrote it.
_left: dict[str, tuple[SparkSession, int]] = {}


def written(df: DataFrame, spark: SparkSession, wide: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and lost executors cost no recomputation.

    Shuffles that made it are deleted at once; the table itself by discard(), or when Python ends. wide: for rows of
    some MB, how many of them a row group may hold, and Arrow batches are small: by default Parquet looks at sizes every
    100 rows only, and what Spark reads at once is a row group.
    """
    path = f"{scratch_dir(spark)}/polyfold-{uuid.uuid4().hex}"
    _left[path] = spark, threading.get_ident()
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(min(int(rows), ROWS_PER_BATCH)), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}  # rows may be long texts
    if wide:
        conf["spark.sql.execution.arrow.maxBytesPerBatch"] = str(WIDE_BYTES)
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df.write.options(compression="zstd", **(WIDE | {"parquet.block.row.count.limit": wide} if wide else {})).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._polyfold_path = path
    return out


def _delete(path: str) -> None:
    if path in _left:
        spark, _ = _left.pop(path)
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in tables:
        _delete(getattr(df, "_polyfold_path", ""))


def finished(make: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """What make returns, written; tables that this thread wrote on the way are deleted."""
    before = set(_left)
    out = written(make(), spark)
    for path, (_, thread) in list(_left.items()):
        if path not in before and path != out._polyfold_path and thread == threading.get_ident():
            _delete(path)
    return out


@atexit.register
def _discard_all() -> None:
    for path in list(_left):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001 - the JVM may be gone, and its folder with it
            _left.clear()


#: Edges, after each partition's own contraction, that one task may join up.
SMALL_EDGES = 200_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges and, for each, the smallest node it is connected with."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            return ids, ids[label]
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]


def _contract(edges: DataFrame, roots: bool) -> DataFrame:
    """u, v: the edges of each partition as stars around their smallest nodes; with roots, also those themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if t:
            node, low = forest(np.concatenate([x for x, _ in t]), np.concatenate([y for _, y in t]))
            some = np.ones(len(node), bool) if roots else node != low
            yield pa.RecordBatch.from_pydict({"u": pa.array(node[some], pa.int64()), "v": pa.array(low[some], pa.int64())})

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """Connected components: node, component (the smallest node reachable), each node once. edges: columns a, b.

    Each partition first contracts its own edges to stars. If at most SMALL_EDGES are left (they are counted),
    one executor task joins them up. Else large-star and small-star steps alternate, written to the shared
    folder, until nothing changes: the smallest neighbour of a node is pre-aggregated before its shuffle, and
    the join back is one that adaptive execution can split at a hub. Nothing but counts reaches the driver.
    """
    e = written(_contract(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), False), spark)
    if e.count() <= SMALL_EDGES:
        out = written(_contract(e.coalesce(1), True).toDF("node", "component"), spark)
        discard(e)
        return out
    # Done when a step changes nothing: the edges are then stars whose centres are the smallest nodes.
    state = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")).toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(small, spark)
        discard(e)
        e, after = new, state(new)
        if before == after:
            break
        before = after
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct().toDF("node", "component"))
    out._polyfold_path = e._polyfold_path
    return out


#: Parts that the rows of one key are dealt to where a key may be hot.
SALTS = 16


def salted_join(rows: DataFrame, values: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with values (one row a key): a hot key's rows are dealt to SALTS tasks by another column."""
    (salt,) = fresh([*rows.columns, *values.columns], "_salt")
    many = values.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(many, [key, salt]).drop(salt)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that agree in keys, from batches in which equal keys stand together.

    Yields tables of one or more whole groups; only the group at a batch's end is carried over, so memory
    is bounded by a batch and the largest group.
    """
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t[k].combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if held and any(held[-1][k][-1].as_py() != t[k][0].as_py() for k in keys):
            yield pa.concat_tables(held)
            held = []
        if last:
            yield pa.concat_tables([*held, t.slice(0, last)])
            held = []
        held.append(t.slice(last))
    if held:
        yield pa.concat_tables(held)


def group_bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the groups of t, and its number of rows."""
    change = np.zeros(t.num_rows, bool)
    change[:1] = True
    for k in keys:
        x = t[k].combine_chunks().to_numpy(zero_copy_only=False)
        change[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(change), t.num_rows)
