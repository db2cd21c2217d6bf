import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polyfold.functions import filters as P
from polyfold.functions import fracdex, ftsquery, jsonval, sketch, text, vector


@pytest.mark.parametrize("a, b", [("F", "V"), ("F", "G"), ("FF", "FV"), (None, "1"), ("z", None), (None, None), ("0V", "1")])
def test_key_between(a, b):
    k = fracdex.key_between(a, b)
    assert (a is None or a < k) and (b is None or k < b) and not k.endswith("0")


def test_key_between_squeezed():
    a, b = "F", "G"
    for i in range(1000):
        k = fracdex.key_between(a, b)
        assert a < k < b
        a, b = (k, b) if i % 2 else (a, k)
    assert len(k) <= 300
    with pytest.raises(ValueError):
        fracdex.key_between("V", "V")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60))
def test_key_between_keeps_any_order(places):
    keys = []
    for p in places:
        p = min(p, len(keys))
        keys.insert(p, fracdex.key_between(keys[p - 1] if p else None, keys[p] if p < len(keys) else None))
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


VALUES = ['{"a":{"b":5}}', '{"a":{"b":"5"}}', '{"a":{"b":"abc"}}', '{"a":{"b":true}}', '{"a":{"b":null}}', '{"a":{}}', '{"a":{"b":[1,2]}}', '{"a":{"b":2.5}}', '{"a":{"b":{"c":1}}}']


def test_json_compare_is_sqlites(spark):
    import sqlite3

    db = sqlite3.connect(":memory:")
    d = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, body string")
    ops = {"==": "=", "!=": "<>", ">": ">", ">=": ">=", "<": "<", "<=": "<="}
    cases = [(op, v) for op in ops for v in (5, "5", True, 2.5, None, "abc")]
    got = jsonval.parsed(d).select("i", *[jsonval.compare(F.col("_json"), "a.b", op, v).alias(f"c{k}") for k, (op, v) in enumerate(cases)]).orderBy("i").collect()
    for r, body in zip(got, VALUES):
        for k, (op, v) in enumerate(cases):
            want = db.execute(f"SELECT json_extract(?, '$.a.b') {ops[op]} ?", (body, v)).fetchone()[0]
            assert r[f"c{k}"] == (None if want is None else bool(want)), (body, op, v)


def test_json_sort_and_found(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, body string")
    d = jsonval.parsed(d)
    order = [r["i"] for r in d.orderBy(*jsonval.sort_keys(F.col("_json"), "a.b"), "i").collect()]
    assert order == [4, 5, 3, 7, 0, 1, 6, 2, 8]
    assert [r[0] for r in d.orderBy("i").select(jsonval.found(F.col("_json"), "a.b")).collect()] == [True] * 5 + [False] + [True] * 3


def test_filters():
    f = P.q("a").b >= 3
    assert (f.path, f.op, f.value) == ("a.b", ">=", 3)
    with pytest.raises(ValueError):
        P.q("a'; drop") == 1  # noqa: B015
    with pytest.raises(TypeError):
        P.checked_filters((True,))


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("triplicate", "triplic"), ("formalize", "formal"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("databases", "databas"), ("happily", "happili")])
def test_porter(word, stem):
    assert text.porter(word) == stem


def test_porter_is_sqlites():
    import sqlite3

    rng = random.Random(5)
    parts = ["relat", "hop", "fall", "agre", "gener", "oscill", "y", "tion", "ational", "izer", "ing", "ed", "s", "ness", "ful", "ement", "e", "ies", "ll", "iviti", "able", "ous", "logi", "bli"]
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(600)})
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(c, tokenize='porter')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    db.executemany("INSERT INTO t(rowid, c) VALUES (?, ?)", list(enumerate(words)))
    want = dict(db.execute("SELECT doc, term FROM v"))
    bad = [(w, text.porter(w), want[i]) for i, w in enumerate(words) if text.porter(w) != want[i]]
    assert not bad


def test_tokens(spark):
    d = spark.createDataFrame([("Café x_y 3.14 ÉCOLE naïve",)], "t string")
    assert d.select(text.tokens(F.col("t"))).first()[0] == ["cafe", "x", "y", "3", "14", "ecole", "naive"] == text.tokens_of("Café x_y 3.14 ÉCOLE naïve")


@pytest.mark.parametrize("bad", ["", "a AND", "AND a", "(a", "a)", '"a', "a AND NOT b", "title : a", "NEAR(a b", "a (b)", "NEAR(a, x)", "a $ b"])
def test_bad_queries(bad):
    with pytest.raises(ValueError):
        ftsquery.parse(bad, str.split)


def test_query_shapes():
    p = ftsquery.parse('a b OR "c d" NOT e*', text.tokens_of)
    assert p.op == "OR" and p.parts[0].op == "AND" and p.parts[1].op == "NOT" and p.parts[1].parts[1].prefix


def test_sketch_sizes():
    assert sketch.hll_precision(0.01) == 14 and sketch.bloom_size(1000, 0.01) == (9586, 7)


def test_hll_and_bloom(spark):
    d = spark.range(1000).select(F.col("id").cast("string").alias("x"))
    item = sketch.item_text(F.col("x"))
    regs = {r["register"]: r["rank"] for r in sketch.hll_registers(d, item).collect()}
    want: dict[int, int] = {}
    for i in range(1000):
        h = int.from_bytes(hashlib.sha1(f'"{i}"'.encode()).digest()[:8], "little")
        w, k = h >> 14, h & 16383
        want[k] = max(want.get(k, 0), min(((w & -w).bit_length() - 1) if w else 64, 50) + 1)
    assert regs == want
    n = sketch.hll_count(sketch.hll_registers(d, item)).first()[0]
    assert 950 < n < 1050
    bits = sketch.bloom_bits(d, item, 1000, 0.01)
    want_bits = set()
    for i in range(1000):
        m = hashlib.md5(f'"{i}"'.encode()).digest()
        a, b = int.from_bytes(m[:8], "little"), int.from_bytes(m[8:], "little")
        want_bits |= {(a + j * b) % 9586 for j in range(7)}
    assert {r[0] for r in bits.collect()} == want_bits
    probe = spark.range(500, 2500).select("id", F.col("id").cast("string").alias("x"))
    got = {r["id"]: r["maybe"] for r in sketch.bloom_contains(probe, "id", item, bits, 1000, 0.01).collect()}
    assert all(got[i] for i in range(500, 1000)) and sum(got[i] for i in range(1000, 2500)) < 60
    half = sketch.hll_registers(d.where("cast(x as int) < 500"), item), sketch.hll_registers(d.where("cast(x as int) >= 500"), item)
    assert {r["register"]: r["rank"] for r in sketch.hll_merge(*half).collect()} == want


def test_distances(spark):
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(50, 6)), rng.normal(size=6)
    d = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "i int, v array<double>")
    r = d.orderBy("i").select(vector.cosine(F.col("v"), q), vector.euclid(F.col("v"), q), vector.manhattan(F.col("v"), q)).collect()
    cos = (1 - x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q) + 1e-10)) / 2
    assert np.allclose([list(a) for a in r], np.stack([cos, np.linalg.norm(x - q, axis=1), np.abs(x - q).sum(1)], 1))
    old, vector.UNROLL = vector.UNROLL, 2
    try:
        assert np.allclose([a[0] for a in d.orderBy("i").select(vector.euclid(F.col("v"), q)).collect()], np.linalg.norm(x - q, axis=1))
    finally:
        vector.UNROLL = old
