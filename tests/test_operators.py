import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyfold.functions import filters as P
from polyfold.functions import vector as V
from polyfold.operators import docs, fieldindex, graph, kv, log, queue, seq, vectors

TEXTS = [
    "python is a programming language and databases of happily running programs",
    "java programs run on a machine; the machine runs Java",
    "the quick brown fox jumps over the lazy dog quick quick",
    "Café society meets python in the café, near the quick river",
    "running runner runs ran, x_y and 3.14",
    "dogs and foxes; a fox and a dog",
]
QUERIES = ["python", "running", "python NOT java", "fox dog", "quick OR java", '"quick brown"', "prog*", "NEAR(fox dog, 2)", "NEAR(quick river, 1)", "^the", "cafe", "(python OR java) AND program", "x_y", "dog AND (quick OR foxes)", 'lazy + dog', "machine java", "nothinghere"]


@pytest.fixture(scope="module")
def indexed(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    index = docs.index_rows(docs.flatten_columns(d, "id", {"t": F.col("t")})).cache()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(c, tokenize='porter')")
    db.executemany("INSERT INTO t(rowid, c) VALUES (?, ?)", list(enumerate(TEXTS)))
    return index, docs.postings(index).cache(), db


@pytest.mark.parametrize("q", QUERIES)
def test_full_text_is_sqlites(indexed, q):
    index, post, db = indexed
    want = {i: s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (q,))}
    for options in ({}, {"post": post}):
        got = {r["id"]: r["score"] for r in docs.full_text(index, q, **options).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("q", ["NEAR(aa bb cc, 2)", 'NEAR(aa "bb cc" dd, 3)', "NEAR(aa bb, 1)", "NEAR(aa bb cc dd, 5)", "NEAR(aa aa bb, 2)", "NEAR(aa bb* cc, 1)"])
def test_near_is_sqlites(spark, q):
    rng = random.Random(q)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg", "bbx"]) for _ in range(rng.randrange(4, 25)))) for i in range(150)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(c, tokenize='porter')")
    db.executemany("INSERT INTO t(rowid, c) VALUES (?, ?)", rows)
    want = {i for (i,) in db.execute("SELECT rowid FROM t WHERE t MATCH ?", (q,))}
    index = docs.index_rows(docs.flatten_columns(spark.createDataFrame(rows, "id long, t string"), "id", {"t": F.col("t")}))
    assert {r["id"] for r in docs.full_text(index, q).collect()} == want and 0 < len(want) < 150


def test_documents(spark):
    rows = [("a", '{"name": "Laptop", "price": 1000, "category": "tech", "tags": ["x", "Python"]}'), ("b", '{"name": "Phone", "price": 500, "category": "tech"}'), ("c", '{"name": "Apple", "price": 1, "category": "food", "n": {"m": " "}}'), ("d", '"The qick brown fx"'), ("e", "not json")]
    d = spark.createDataFrame(rows, "id string, body string")
    q = docs.DocumentQuery(d).where(P.q("category") == "tech").sort(price="DESC")
    assert [r["id"] for r in q.frame().collect()] == ["a", "b"]
    leaves = {(r["id"], r["field_path"], r["field_content"]) for r in docs.flatten(d).collect()}
    assert ("a", "tags", "Python") in leaves and ("d", "", "The qick brown fx") in leaves and not any(x[1] == "n.m" for x in leaves)
    assert [r["id"] for r in docs.search(d, "python", on=["tags"]).collect()] == ["a"]
    assert docs.search(d, "python", on=["name"]).count() == 0
    got = docs.search(d, "quick", fuzzy=True).collect()
    assert [(r["id"], r["score"]) for r in got] == [("d", 1.0)]
    assert docs.search(d, "ab", fuzzy=True).count() == 0
    assert docs.search(d, offset=3).count() == 5 and docs.search(d, limit=2, offset=4).count() == 1
    with pytest.raises(TypeError):
        docs.DocumentQuery(d).where("x")
    with pytest.raises(ValueError):
        docs.DocumentQuery(d).sort(price="UP")


def test_kv(spark):
    d = spark.createDataFrame([("a", "1", None), ("b", "2", 100.0)], "key string, value string, expires_at double")
    assert kv.get(d, "b", 100.0).count() == 1 and kv.get(d, "b", 100.1).count() == 0
    assert kv.count(d).first()[0] == 2
    with pytest.raises(ValueError):
        kv.check_ttl(0)
    with pytest.raises(ValueError):
        kv.check_ttl(True)
    ops = spark.createDataFrame([("a", "put", 1, "x"), ("a", "put", 3, "y"), ("b", "put", 2, "z"), ("b", "del", 4, None)], "key string, op string, seq long, value string")
    assert [tuple(r) for r in kv.latest(ops).select("key", "value").collect()] == [("a", "y")]
    s = kv.Secret("pw")
    assert s == "pw" and s != "no" and kv.Secret.from_json(s.to_json()) == "pw"


def test_sequence_against_a_python_list(spark):
    items = [(f"{i:02d}V", str(i)) for i in range(7)]
    d = spark.createDataFrame(items, "item_order string, item_value string").cache()
    for i in range(-9, 9):
        got = [r["item_value"] for r in seq.at(d, i).collect()]
        assert got == ([str(i % 7)] if -7 <= i < 7 else [])
    rng = random.Random(1)
    for _ in range(12):
        a, b = (rng.choice([None, *range(-9, 10)]) for _ in range(2))
        assert [r["item_value"] for r in seq.ordered(seq.slice_(d, a, b)).collect()] == [v for _, v in items][a:b]
    with pytest.raises(ValueError):
        seq.slice_(d, 0, 2, 2)
    assert seq.insert_key(d, 0) < "00V" and "00V" < seq.insert_key(d, 1) < "01V" and seq.insert_key(d, 99) > "06V" and seq.insert_key(d, -3) < "00V"


def test_queue_and_log(spark):
    d = spark.createDataFrame([(10.0, 1.0, 1, "mid"), (20.0, 1.0, 2, "low"), (1.0, 2.0, 3, "high"), (1.0, 2.0, 4, "high2")], "priority double, timestamp double, seq long, data string")
    assert [r["data"] for r in queue.ordered(d).collect()] == ["high", "high2", "mid", "low"]
    taken, left = queue.drain(d, 2)
    assert {r["data"] for r in taken.collect()} == {"high", "high2"} and left.count() == 2
    assert log.monotonic([(5.0, "a"), (5.0, "b"), (1.0, "c"), (9.0, "d")], 4.0) == [(5.0, "a"), (5.0 + 1e-6, "b"), (5.0 + 2e-6, "c"), (9.0, "d")]
    e = spark.createDataFrame([(1, 5.0, "x"), (2, 5.0, "x"), (3, 1.0, "x")], "seq long, timestamp double, name string")
    assert [r["timestamp"] for r in log.monotonic_frame(e, None, ["name"]).orderBy("seq").collect()] == [5.0, 5.0 + 1e-6, 5.0 + 2e-6]
    with pytest.raises(ValueError):
        log.range_(d, order="UP")


def test_index_and_scan_agree(spark):
    bodies = ['{"x": %s}' % v for v in ("900", '"900"', "true", "900.0", "null", "[1]", '"abc"', "5")] + ["{}"]
    d = spark.createDataFrame([(float(i), b) for i, b in enumerate(bodies)], "timestamp double, data string")
    ix = fieldindex.materialise(d, ["x"])
    m = fieldindex.Manifest().declare("x", complete=True)
    for op in ("__eq__", "__ne__", "__gt__", "__ge__", "__lt__", "__le__"):
        for v in (900, "900", True, 5.0, None, "abc"):
            f = [getattr(P.q("x"), op)(v)]
            plain, typed = ([r["timestamp"] for r in log.range_(x, where=f, manifest=y).collect()] for x, y in ((d, None), (ix, m)))
            assert plain == typed, (op, v)
    assert [r["timestamp"] for r in log.range_(d, where=[P.q("x").is_null()]).collect()] == [4.0, 8.0]
    ex = fieldindex.explain(d, [P.q("x") == 1, P.q("y") == 1], m)
    assert ex == {"indexed": ["x"], "scanned": ["y"], "estimated_rows": 9}
    with pytest.raises(Exception, match="array or object"):
        fieldindex.rows(d, "timestamp", "data", ["x"]).collect()
    ok = fieldindex.rows(d.where("timestamp <> 5"), "timestamp", "data", ["x"])
    assert {(r["item_key"], r["value"], r["value_num"]) for r in ok.collect()} >= {(0.0, "900", 900.0), (1.0, "900", None), (2.0, "true", 1.0), (4.0, None, None)}


def test_typed_filters_reach_the_scan(spark, tmp_path):
    d = spark.createDataFrame([(float(i), '{"k": %d}' % i) for i in range(10)], "timestamp double, data string")
    fieldindex.materialise(d, ["k"]).write.parquet(str(tmp_path / "log"))
    m = fieldindex.Manifest().declare("k", complete=True)
    out = log.range_(spark.read.parquet(str(tmp_path / "log")), 2.0, 8.0, [P.q("k") < 5], manifest=m).select("timestamp")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(ix_k_num), GreaterThanOrEqual(timestamp,2.0)" in plan.replace("LessThan(ix_k_num,5.0), ", "") and "ReadSchema: struct<timestamp:double,ix_k_num:double>" in plan
    assert out.count() == 3


def test_vectors(spark):
    d = spark.createDataFrame([("A", [1.0, 0.0], '{"c":"s","v":100}'), ("B", [0.0, 1.0], '{"c":"n","v":500}'), ("C", [0.9, 0.1], None)], "item_id string, vector array<float>, metadata string")
    ids = lambda **k: [r["item_id"] for r in vectors.near(d, [0.95, 0.05], 2, **k).collect()]
    assert set(ids()) == {"A", "C"} and ids(candidate_ids=["B"]) == ["B"] and ids(candidate_ids=[]) == []
    assert ids(filters=[P.q("v") > 200]) == ["B"] and ids(metric="euclid")[0] in "AC"
    assert [round(r["score"], 6) for r in vectors.near(d, [1.0, 0.0], 3, metric=lambda m, q: 1 - m @ q).collect()] == [0.0, 0.1, 1.0]
    with pytest.raises(ValueError):
        ids(metric="nope")
    with pytest.raises(ValueError):
        vectors.check_vector([1.0], 2)


def test_lsh(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 32))
    x = (centers[rng.integers(0, 20, 600)] + 0.02 * rng.normal(size=(600, 32))).astype(np.float32)
    planes = V.hyperplanes(32)
    d = vectors.with_bucket(spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], "item_id long, vector array<float>, metadata string"), planes).cache()
    assert [r["bucket"] for r in d.orderBy("item_id").collect()] == [V.bucket_of(v, planes) for v in x]
    overlap = 0
    for i in range(10):
        exact = {r["item_id"] for r in vectors.near(d, x[i].tolist(), 10).collect()}
        overlap += len(exact & {r["item_id"] for r in vectors.near(d, x[i].tolist(), 10, method="lsh", planes=planes).collect()})
    assert overlap >= 90  # recall of at least 0.9 on clustered data
    far = vectors.near(d.where("false"), x[0].tolist(), 3, method="lsh", planes=planes)
    assert far.count() == 0
    many = vectors.near_many(d, [(i, x[i].tolist()) for i in range(3)], 5).collect()
    assert len(many) == 15 and all(any(r["query_id"] == r["item_id"] for r in many if r["query_id"] == i) for i in range(3))


def test_nearest_of_many_with_ties(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 50)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 16)).astype(np.float32)
    x[rng.permutation(240)[:90]] = x[0]  # a group of copies, larger than k
    ids = rng.permutation(240)
    d = spark.createDataFrame([(int(i), v.tolist(), None) for i, v in zip(ids, x)], "item_id long, vector array<float>, metadata string").coalesce(2)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {}
    for i, q in zip(ids, u):
        if i % 20 == 0:
            ranked = sorted((round(float((1 - (q * v).sum()) / 2), 9), int(j)) for j, v in zip(ids, u))
            want |= {(int(i), j): s for s, j in ranked[:7]}
    each = vectors.near_each(d, d.where("item_id % 20 = 0").selectExpr("item_id as query_id", "vector"), 7).collect()
    many = vectors.near_many(d, [(int(i), v.tolist()) for i, v in zip(ids, x) if i % 20 == 0], 7).collect()
    for got in (each, many):
        assert len(got) == 84 and {(r["query_id"], r["item_id"]) for r in got} == set(want)
        assert all(abs(r["score"] - want[r["query_id"], r["item_id"]]) < 1e-6 for r in got)


def test_graph(spark):
    g = spark.createDataFrame([("r", "a", "p", None), ("r", "b", "p", None), ("a", "r", "back", None), ("r", "a", "q", '{"w":1}')], "source string, target string, label string, metadata string")
    assert sorted(r[0] for r in graph.children(g, "r").collect()) == ["a", "a", "b"]
    assert [r[0] for r in graph.children(g, "r", "q").collect()] == ["a"] and [r[0] for r in graph.parents(g, "r").collect()] == ["a"]
    assert graph.unlink(g, g.where("label = 'p'")).count() == 2
    walk = {(r["node"], r["depth"]) for r in graph.walk(g, spark.createDataFrame([("r",)], "node string"), 5).collect()}
    assert walk == {("r", 0), ("a", 1), ("b", 1)}


def test_lsh_recall_without_clusters(spark):
    planes = V.hyperplanes(64)
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    d = vectors.with_bucket(e.selectExpr("vec_id as item_id", "embedding as vector", "cast(null as string) as metadata"), planes).cache()
    probes = [list(r["vector"]) for r in d.where("item_id % 50 = 0").collect()]
    found = 0
    for p in probes:
        exact = {r["item_id"] for r in vectors.near(d, p, 10).collect()}
        found += len(exact & {r["item_id"] for r in vectors.near(d, p, 10, method="lsh", planes=planes, radius=9).collect()})
    assert found >= 0.9 * 10 * len(probes)


def test_positions_without_bringing_a_list_together(spark, monkeypatch):
    d = spark.createDataFrame([(f"{i:03}", str(i)) for i in range(60)], "item_order string, item_value string").repartition(5)
    one = lambda x: [r["item_value"] for r in seq.ordered(x).collect()]
    whole = [str(i) for i in range(60)]
    for a, b in ((3, 9), (None, 5), (-4, None), (50, 99), (-99, 2), (9, 3), (None, None)):
        assert one(seq.slice_(d, a, b)) == whole[a:b]
    for edge in (0, 1000):
        monkeypatch.setattr(seq, "NEAR_END", edge)
        assert [one(seq.at(d, i)) for i in (0, 17, 59, -1, -60, 60, -61)] == [["0"], ["17"], ["59"], ["59"], ["0"], [], []]
        assert seq.bounds_for_insert(d, 17) == ("016", "017") and seq.bounds_for_insert(d, 60) == ("059", None) and seq.bounds_for_insert(d, 99) == ("059", None)
