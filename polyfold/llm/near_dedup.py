"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document becomes its set of hashed word shingles; equal sets are one class from here on.
2. Banded MinHash signatures give candidates. Signatures of candidates are compared in batches: a pair is
   dropped as soon as the posterior probability that its similarity reaches the threshold falls below the
   chosen miss probability (uniform prior; the posterior tail is a binomial sum).
3. Survivors are verified on their full sets, and links become connected components.

A bucket's pairs are never all emitted. First each class is verified against one leader, the smallest class
of a bucket it shares most bands with. Buckets that still hold several components are then compared across
components, in bounded blocks of rows whose pairs stay inside numpy: in the first rounds each row gives its
best pair only, which joins most of a hot group; the last round gives every plausible pair between
components that are left, each from the first bucket it shares. So no link between buckets' members is lost,
and no bucket meets in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyfold.llm import common as C

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
MISS = 1e-6
#: Hashes that are compared at a time.
BATCH = 32
#: Rows of a block of a bucket.
BLOCK = 512
#: Rounds of best pairs, at most, before the round of all pairs.
BEST_ROUNDS = 1
_rng = np.random.default_rng(8128)
_A = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each document's k-word shingles, in lower case (A-Z).

    A document of fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    low = C.LOWER[data]
    starts, ends, first = C.words(low, offs)
    h = C.string_hash(low, starts, ends)
    g = C.grams(h, k) if len(h) >= k else h[:0]
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            x = np.sort(g[a : b - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(C.mix(C.grams(h[a:b], b - a) + C.U64(b - a)) if b > a else h[:0])
    return out


def signature(x: np.ndarray) -> np.ndarray:
    """MinHash values of a set of hashes."""
    low = (x >> C.U64(16)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 256):
        t = low[i : i + 256, None] * _A
        t ^= _B
        np.minimum(best, t.min(0), out=best)
    return best


def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """For each batch end n: the fewest matches m at which P(similarity >= threshold | m of n) >= miss.

    With a uniform prior that posterior tail equals P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def plausible(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of signatures a and b survive every batch."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for step, need in enumerate(least):
        cut = slice(step * BATCH, (step + 1) * BATCH)
        matches = matches + (a[alive, cut] == b[alive, cut]).sum(1)
        ok = matches >= need
        alive, matches = alive[ok], matches[ok]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _signatures(x: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    x = x.cast(pa.large_binary())
    if not len(x):
        return np.zeros((0, HASHES), np.uint16)
    offs = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.uint16).reshape(len(x), HASHES)


def _numpy(x: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False) if isinstance(x, pa.Array) else x.combine_chunks().to_numpy(zero_copy_only=False)


def _keys(sets: list[np.ndarray]) -> dict[str, np.ndarray]:
    """n (set size), k1 and k2: 128 bits that tell sets apart."""
    one, two = (np.array([f(x).sum(dtype=C.U64) for x in sets], C.U64).view(np.int64) for f in (C.mix, lambda x: C.mix(x ^ C.U64(0x5DEECE66D))))
    return {"n": np.array([len(x) for x in sets], np.int64), "k1": one, "k2": two}


def features(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, k1, k2 and sig (the signature, 16 bits a hash) of each row."""

    def run(batch: pa.RecordBatch):
        for i, j, data, offs in C.pieces(batch.column(1)):
            sets = shingle_sets(data, offs, k)
            sig = np.stack([signature(x) for x in sets]).astype(np.uint16)
            yield _keys(sets) | {"doc_id": batch.column(0).slice(i, j - i), "sig": pa.array([x.tobytes() for x in sig], pa.binary())}

    return C.arrow_map(docs, run, "doc_id long, n long, k1 long, k2 long, sig binary")


def bands(reps: DataFrame) -> DataFrame:
    """key, band, rep: the buckets of each class."""

    def run(batch: pa.RecordBatch):
        sig = _signatures(batch.column("sig")).reshape(-1, BANDS, ROWS).astype(C.U64)
        key = np.broadcast_to(np.arange(BANDS, dtype=C.U64), sig.shape[:2])
        for c in range(ROWS):
            key = C.mix(key * C.U64(0x9E3779B97F4A7C15) + sig[:, :, c])
        for i in range(0, len(sig), 1024):
            k = key[i : i + 1024]
            yield {"key": k.ravel().view(np.int64), "band": np.tile(np.arange(BANDS, dtype=np.int32), len(k)), "rep": np.repeat(_numpy(batch.column("rep"))[i : i + 1024], BANDS)}

    return C.arrow_map(reps.select("rep", "sig"), run, "key long, band int, rep long")


def class_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """id, items: the full shingle set of each class of wanted (rep, low, n, k1, k2), once.

    A class's set comes from a text of its smallest document, found again by the set itself: other texts of that
    document belong to other classes.
    """
    some = docs.join(wanted.select(F.col("low").alias("_id")).distinct(), docs["doc_id"] == F.col("_id"), "left_semi")

    def run(batch: pa.RecordBatch):
        for i, j, data, offs in C.pieces(batch.column(1)):
            sets = shingle_sets(data, offs, k)
            yield _keys(sets) | {"items": pa.array([x.tobytes() for x in sets], pa.binary())}

    keys = ["n", "k1", "k2"]
    return C.arrow_map(some.select("doc_id", "text"), run, "n long, k1 long, k2 long, items binary").dropDuplicates(keys).join(wanted.select(F.col("rep").alias("id"), *keys), keys).select("id", "items")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    z = np.sort(np.concatenate([x, y]))
    both = int((z[1:] == z[:-1]).sum())
    return 100 * both >= percent * (len(z) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets (id, items) satisfy 100 * intersection >= percent * union."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")

    def test(batch: pa.RecordBatch):
        at = pa.array([i for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))) if _linked(np.frombuffer(x.as_buffer(), C.U64), np.frombuffer(y.as_buffer(), C.U64), percent)], pa.int64())
        yield {"a": batch.column("a").take(at), "b": batch.column("b").take(at)}

    return C.arrow_map(both.select("a", "b", "sa", "sb"), test, "a long, b long")


def verified_blocks(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The same for tasks (task, a, b: lists of pairs): each set comes once to a task, whatever its pairs."""
    members = tasks.select("task", F.explode(F.array_distinct(F.concat("a", "b"))).alias("_id"))
    none = F.lit(None).cast("array<long>")
    rows = members.join(sets, F.col("_id") == F.col("id")).select("task", "id", "items", none.alias("a"), none.alias("b"))
    rows = rows.union(tasks.select("task", F.lit(None).cast("long"), F.lit(None).cast("binary"), "a", "b"))
    rows = rows.repartition("task").sortWithinPartitions("task")

    def test(batches):
        for t in C.runs(batches, ["task"]):
            at = C.group_bounds(t, ["task"])
            ids, items = t["id"].to_pylist(), t["items"].combine_chunks()
            pairs_a, pairs_b = t["a"].combine_chunks(), t["b"].combine_chunks()
            out = []
            for lo, hi in zip(at[:-1], at[1:]):
                sets = {ids[i]: np.frombuffer(items[i].as_buffer(), C.U64) for i in range(lo, hi) if ids[i] is not None}
                for i in range(lo, hi):
                    if ids[i] is None:
                        out += [(x, y) for x, y in zip(pairs_a[i].as_py(), pairs_b[i].as_py()) if _linked(sets[x], sets[y], percent)]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.mapInArrow(test, "a long, b long")


def _size_ok(x, y, percent: int):
    """A pair can only reach the threshold if the smaller set holds percent of the larger one."""
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def _leaders(multi: DataFrame, reps: DataFrame, percent: int, least: np.ndarray) -> DataFrame:
    """For each class one plausible pair with the leader that it shares most buckets with."""
    star = multi.where("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("c")).groupBy("rep").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("leader"))
    both = star.join(reps.select("rep", F.col("n").alias("nb"), F.col("sig").alias("sb")), "rep").join(reps.select(F.col("rep").alias("leader"), F.col("n").alias("na"), F.col("sig").alias("sa")), "leader")

    def run(batch: pa.RecordBatch):
        ok = _size_ok(_numpy(batch.column("na")), _numpy(batch.column("nb")), percent)
        ok &= plausible(_signatures(batch.column("sa")), _signatures(batch.column("sb")), least)
        at = pa.array(np.flatnonzero(ok))
        yield {"a": batch.column("leader").take(at), "b": batch.column("rep").take(at)}

    return C.arrow_map(both.select("leader", "rep", "na", "nb", "sa", "sb"), run, "a long, b long")


def _across(multi: DataFrame, reps: DataFrame, comps: DataFrame, percent: int, least: np.ndarray, best: bool) -> DataFrame:
    """Plausible pairs between different components that share a bucket, as lists a and b, one row a block and block.

    With best, each row gives its best pair of a block only.

    In each unresolved bucket the component with most rows is the heavy one. Its rows are cut into blocks and
    meet the other rows' blocks; those also meet each other. Blocks have a bounded expected size.
    """
    rows = multi.select("key", "band", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("comp"))
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    open_ = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("heavy"), F.sum("c").alias("all"), F.count("*").alias("m")).where("m > 1")
    blocks = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    open_ = open_.select("key", F.col("heavy.comp").alias("hc"), blocks(F.col("heavy.c")).alias("nh"), blocks(F.col("all") - F.col("heavy.c")).alias("nl"))
    r = rows.join(open_, "key").withColumn("is_heavy", F.col("comp") == F.col("hc"))
    r = r.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("is_heavy"), F.col("nh")).otherwise(F.col("nl"))).cast("int"))
    seq = lambda n: F.sequence(F.lit(0), n - 1)
    # A task is (i, j): light block i with light block j >= i, or with heavy block -1 - j.
    light = F.concat(F.transform(seq(F.col("nl")), lambda x: F.struct(F.least(F.col("own"), x).alias("i"), F.greatest(F.col("own"), x).alias("j"))), F.transform(seq(F.col("nh")), lambda x: F.struct(F.col("own").alias("i"), (-1 - x).alias("j"))))
    heavy = F.transform(seq(F.col("nl")), lambda x: F.struct(x.alias("i"), (-1 - F.col("own")).alias("j")))
    r = r.join(reps.select("rep", "n", "sig"), "rep").select("key", "band", "rep", "comp", "n", "sig", "own", "is_heavy", F.explode(F.when(F.col("is_heavy"), heavy).otherwise(light)).alias("t"))
    r = r.select("key", F.col("t.i").alias("i"), F.col("t.j").alias("j"), "band", "rep", "comp", "n", "sig", "own", "is_heavy").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    keys = ["key", "i", "j"]

    def run(batches):
        for t in C.runs(batches, keys):
            at = C.group_bounds(t, keys)
            rep, comp, n, i, j, own, heavy_row = (_numpy(t[c]) for c in ("rep", "comp", "n", "i", "j", "own", "is_heavy"))
            sig, band = _signatures(t["sig"]), _numpy(t["band"])
            for a, b in zip(at[:-1], at[1:]):
                g = np.arange(a, b)
                left, right = g[(~heavy_row[g]) & (own[g] == i[a])], g[heavy_row[g]] if j[a] < 0 else g[(~heavy_row[g]) & (own[g] == j[a])]
                found_a, found_b = [], []
                for x in left:
                    y = right[(comp[right] != comp[x]) & _size_ok(n[right], n[x], percent)]
                    if i[a] == j[a]:
                        y = y[y > x]
                    if len(y):
                        y = y[plausible(sig[y], np.broadcast_to(sig[x], (len(y), HASHES)), least)]
                    if len(y):
                        same = sig[y] == sig[x]
                        if best:
                            same = same.sum(1)
                            y = y[[np.argmax(same)]] if 100 * same.max() >= (percent - 5) * HASHES else y[:0]
                        else:
                            y = y[same.reshape(len(y), BANDS, ROWS).all(2).argmax(1) == band[a]]
                    found_a.append(np.full(len(y), rep[x]))
                    found_b.append(rep[y])
                if sum(map(len, found_a)):
                    yield pa.RecordBatch.from_pydict({"a": pa.array([np.concatenate(found_a)]), "b": pa.array([np.concatenate(found_b)])})

    return r.mapInArrow(run, "a array<long>, b array<long>")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links, itself included) and kept of every row.

    Links hold for 100 * intersection >= percent * union of shingle sets; rows that repeat an id are linked with each
    other, whatever their texts. Texts without words (null, empty, only separators) have empty sets and link with
    nothing, not even by their id. A null id has a null component, is kept and links nothing. Very long texts count
    whole. Ties go to the smallest id. Sets are compared by 62-bit hashes of their words. An empty table gives an
    empty table. Other columns of docs, whatever their names, are not read.
    """
    spark: SparkSession = docs.sparkSession
    at = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    least = least_matches(percent / 100)
    feat = C.written(features(at, k), spark)
    # Equal sets are one class, numbered by rep; its smallest document is low.
    keys = ["n", "k1", "k2"]
    known = feat.where("n > 0 and doc_id is not null")
    classes = known.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.first("sig").alias("sig"))
    classes = C.written(classes.withColumn("rep", F.monotonically_increasing_id()), spark)
    reps = classes.select("rep", "n", "sig")
    # An id with several sets links its classes.
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    of = known.join(repeated, "doc_id").select("doc_id", *keys).distinct().join(classes.select(*keys, "rep"), keys).select("doc_id", "rep")
    first = of.groupBy("doc_id").agg(F.min("rep").alias("a"))
    links = C.written(of.join(first, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b"), spark)
    buckets = bands(reps)
    full = buckets.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("c")).where("c > 1").select("key", "leader")
    multi = C.written(buckets.join(full, "key"), spark)
    # The sets that any later step may need: those of classes that share a bucket.
    sets = C.written(class_sets(at, classes.select("rep", "low", *keys).join(multi.select("rep").distinct(), "rep", "left_semi"), k), spark)
    parts = [links, C.written(verified(_leaders(multi, reps, percent, least), sets, percent), spark)]
    comps = C.components(parts[0].union(parts[1]), spark)
    rounds, best = 0, True
    while True:
        tasks = C.written(_across(multi, reps, comps, percent, least, best), spark)
        if best:
            pairs = tasks.select(F.explode(F.arrays_zip("a", "b")).alias("p")).select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).distinct()
            more = verified(pairs, sets, percent)
        else:
            more = verified_blocks(tasks.select(F.monotonically_increasing_id().alias("task"), "a", "b"), sets, percent)
        parts.append(C.written(more, spark))
        C.discard(tasks)
        found = not parts[-1].isEmpty()
        if found:
            C.discard(comps)
            links = parts[0]
            for x in parts[1:]:
                links = links.union(x)
            comps = C.components(links, spark)
        if not best:
            break
        rounds += 1
        best = found and rounds < BEST_ROUNDS
    C.discard(multi, sets, *parts)
    # From numbers back to documents: the smallest document of all classes of a component.
    placed = comps.join(classes.select(F.col("rep").alias("node"), "low"), "node")
    found = C.salted_join(placed.select("node", "component"), placed.groupBy("component").agg(F.min("low").alias("least")), "component", "node").select(F.col("node").alias("rep"), "least")
    final = C.written(classes.join(found, "rep", "left").select(*[F.col(x).alias("_" + x) for x in keys], F.coalesce("least", "low").alias("least")), spark)
    rows = C.written(feat.select("doc_id", *keys), spark)
    C.discard(feat, classes, comps)
    out = rows.join(final, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & (F.col("n") == F.col("_n")), "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("least", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
