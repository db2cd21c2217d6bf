import hashlib
import math
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from polyfold.llm import common as C
from polyfold.llm import decontam, langid, lm_score, mixing, near_dedup, quality_classifier, quality_rules, queries, stats, suffix_dedup, token_coder, token_output, url_filter

SF = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    b = (text or "").encode()
    return WORDS.findall(b.lower() if lower else b)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return docs.toPandas()


def odd_rows(odd):
    return [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]


# Near-duplicates
def linked(rows, k, percent=80):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), None if i is None else find(i)) for i, s in sets)


def dedup_rows(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in df.collect())


def test_near_duplicates_are_brute_forces(docs, local, odd, none):
    assert dedup_rows(near_dedup.near_duplicates(docs, k=2)) == linked(list(zip(local.doc_id, local.text)), 2)
    assert dedup_rows(near_dedup.near_duplicates(odd, k=2)) == linked(odd_rows(odd), 2)
    assert near_dedup.near_duplicates(none, k=2).count() == 0


def test_near_duplicates_in_a_hot_group(spark):
    """Many variants around one text, linked in chains and not, so that buckets hold several components."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(60)] = f"v{rng.randrange(12)}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2)
    assert dedup_rows(got) == linked(rows, 2)
    old = near_dedup.BLOCK
    near_dedup.BLOCK = 16
    try:
        assert dedup_rows(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2)) == linked(rows, 2)
    finally:
        near_dedup.BLOCK = old


def test_rows_that_repeat_an_id(spark):
    """An id's rows are one document: its texts link what they are near to, and an empty one links nothing."""
    x, y = ("one two three four five six seven eight nine ten", "red green blue white black grey pink gold brown cyan")
    rows = [(3, x), (5, x), (5, y), (7, y), (8, y + " more"), (9, x.upper()), (11, "alone here"), (11, "alone there"), (None, y), (12, None), (12, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2)
    assert dedup_rows(got) == linked(rows, 2)
    assert {r["component_id"] for r in got.where("doc_id in (3, 5, 7, 8, 9)").collect()} == {3} and got.where("kept and doc_id in (5, 7, 8, 9)").count() == 0


def test_bayesian_bounds():
    least = near_dedup.least_matches(0.8, 1e-6)
    assert list(least) == sorted(least) and all(m < n for m, n in zip(least, range(32, 129, 32)))
    # The posterior tail by numerical integration of the likelihood.
    x = np.linspace(0, 1, 200_001)
    for n, m in zip(range(32, 129, 32), least):
        tail = lambda k: np.sum((x**k * (1 - x) ** (n - k))[x >= 0.8]) / np.sum(x**k * (1 - x) ** (n - k))
        assert tail(m) >= 0.99e-6 > 0.9 * tail(m - 1)


@pytest.mark.parametrize("small", [0, 200_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(C, "SMALL_EDGES", small)
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 500 + i) for i in range(60)]
    root = list(range(600))
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(pairs, "a long, b long"), spark).collect()}
    assert got == {x: root[x] for a, b in pairs if a != b for x in (a, b)}
    assert C.components(spark.createDataFrame([], "a long, b long"), spark).count() == 0


# Repeated bytes
def repeats(texts, length=200):
    first, marks = {}, [np.zeros(len(t) + 1, int) for t in texts]
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in first:
                for a, b in (first[w], (i, p)):
                    marks[a][b] += 1
                    marks[a][b + length] -= 1
            else:
                first[w] = (i, p)
    out = []
    for t, m in zip(texts, marks):
        gone = np.cumsum(m)[: len(t)] > 0
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def repeat_rows(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("group", [0, 20_000])
def test_repeated_bytes_are_brute_forces(spark, odd, none, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = text(230), text(199)
    rows = odd_rows(odd) + [(100 + i, text(rng.randrange(400)) + passage[rng.randrange(40) :] + text(rng.randrange(300)) + (other if i % 2 else passage)) for i in range(12)]
    rows += [(200, passage + passage), (201, "ab" * 300), (202, "ab" * 301), (203, text(600)), (204, rows[-1][1][:450] + "!")]
    want = sorted((str(i), *x) for (i, _), x in zip(rows, repeats([(t or "").encode() for _, t in rows])))
    assert repeat_rows(suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert suffix_dedup.repeated_bytes(none).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_bytes(none, length=64)


def test_remaining_text(odd):
    for r in suffix_dedup.repeated_bytes(odd, with_text=True).collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]


# Token output
@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (5, 1), (2049, 65535), (30_000, 40), (9000, 50257)])
def test_coder_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, top - 1).astype(np.uint32)
    coded = token_coder.encode_segment(ids)
    assert (token_coder.decode_segment(coded) == ids).all()
    if n >= 2049:
        broken = bytearray(coded)
        broken[len(coded) // 2] ^= 1
        with pytest.raises(ValueError):
            token_coder.decode_segment(bytes(broken))
        assert len(coded) < 4 * n


def test_coder_refuses_large_ids():
    with pytest.raises(ValueError):
        token_coder.encode_segment(np.array([65535], np.uint32))


def test_coder_learns():
    ids = np.tile(np.arange(40, dtype=np.uint32) * 1000, 500)
    assert len(token_coder.encode_segment(ids)) < len(ids) / 8


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_files(spark, odd, none, docs, vocabulary):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(vocabulary)
    library = Tokenizer.from_file(path)
    spaces = ["a  b", "a\n\nb", "a \n b  ", "x\xa0 y", "it's 12 ab!?", "  lead", "<|endoftext|>a b", "a\t\tb", " ", "\n", "e\u2003f 　g", "tail \n\n", "a\u0085b"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(spaces)], "doc_id long, text string")
    d = odd.select("doc_id", "text").union(more).union(docs.limit(20).selectExpr("doc_id + 5000", "text"))
    got = token_output.token_files(d, path, with_ids=True).orderBy("start").collect()
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    key = lambda x: (x is not None, x or 0)
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=key)
    want = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    start = 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["start"] == start and r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += len(ids)
        want[r["doc_id"], tuple(ids.tolist())] -= 1
    assert not any(want.values()) and token_output.token_files(none, path).count() == 0


# Language-model scores
def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def test_scores_are_brute_forces(odd, none):
    rows = odd_rows(odd)
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm_score.score_documents(odd).collect()}
    train = [(i, t) for i, t in rows if fold(i, 5) != 1]
    counts = Counter(w for _, t in train for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    # Context-tree weighting with plain recursion over dictionaries of counts.
    seen: dict = {}
    for _, t in train:
        b = b"\0\0" + (t or "").encode()
        for i in range(2, len(b)):
            node = 1
            for k in range(7, -1, -1):
                bit = b[i] >> k & 1
                for depth in range(3):
                    seen.setdefault((b[i - depth : i][::-1], node), [0, 0])[bit] += 1
                node = node * 2 + bit
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    below: dict = {}
    for s, node in seen:
        if s:
            below.setdefault((s[:-1], node), []).append((s, node))
    memo: dict = {}

    def weighted(x):
        if x not in memo:
            own = kt(*seen[x])
            memo[x] = own if len(x[0]) == 2 else np.logaddexp(own, sum(weighted(c) for c in below.get(x, []))) + math.log(0.5)
        return memo[x]

    def prob(context, node, depth=0):
        x = (context[:depth], node)
        a, b = seen.get(x, (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if depth == 2:
            return own
        w = math.exp(kt(a, b) + math.log(0.5) - weighted(x)) if x in seen else 0.5
        return w * own + (1 - w) * prob(context, node, depth + 1)

    for i, t in rows:
        w = [*words(t), None]
        r = got[i, len(w)]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (fold(i, 5) == 1, sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        text, known = b"\0\0" + (t or "").encode(), {}
        if len(text) < 7000:
            score = 0.0
            for k in range(2, len(text)):
                c = (text[k - 2 : k][::-1], text[k])
                if c not in known:
                    known[c], node = 0.0, 1
                    for z in range(7, -1, -1):
                        bit, p = text[k] >> z & 1, prob(c[0], node)
                        known[c] += math.log10(p if bit else 1 - p)
                        node = node * 2 + bit
                score += known[c]
            assert math.isclose(r["score"], score, rel_tol=1e-4, abs_tol=1e-6), (i, r["score"], score)
    assert len(got) == len(set(got)) and lm_score.score_documents(none).count() == 0


def test_probabilities_sum_to_one():
    t = np.random.default_rng(0).integers(0, 1 << 24, 500)
    tree = lm_score.ContextTree.fit(np.unique(t), np.ones(len(np.unique(t))))
    assert np.allclose((10 ** tree.table.astype(float)).sum(1), 1, atol=1e-4)


def test_deep_contexts_are_brute_forces(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "GROUP_BYTES", 200)  # several groups of subtrees
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 500)
    rng = random.Random(4)
    said = ["the cat sat on the mat", "a dog ran to the cat", "the mat ran away"]
    rows = [(i, " ".join(rng.choice(said) for _ in range(rng.randint(0, 6)))) for i in range(30)] + [(None, "no id"), (3, "another text of 3 é"), (40, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    top = 5
    seen: dict = {}
    for i, t in rows:
        if fold(i, 5) != 1:
            b = bytes(top) + (t or "").encode()
            for i in range(top, len(b)):
                node = 1
                for k in range(7, -1, -1):
                    bit = b[i] >> k & 1
                    for depth in range(top + 1):
                        seen.setdefault((b[i - depth : i][::-1], node), [0, 0])[bit] += 1
                    node = node * 2 + bit
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted: dict = {}
    for depth in range(top, -1, -1):
        below: dict = Counter()
        for (s, node), w in weighted.items():
            if len(s) == depth + 1:
                below[s[:-1], node] += w
        for x in [x for x in seen if len(x[0]) == depth]:
            own = kt(*seen[x])
            weighted[x] = own if depth == top else np.logaddexp(own, below[x]) + math.log(0.5)

    def prob(context, node, depth=0):
        x = (context[:depth], node)
        a, b = seen.get(x, (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if depth == top:
            return own
        w = math.exp(kt(a, b) + math.log(0.5) - weighted[x]) if x in seen else 0.5
        return w * own + (1 - w) * prob(context, node, depth + 1)

    got = sorted((r["doc_id"] or -1, r["bits_per_byte"] is None, r["score"]) for r in lm_score.score_documents(d, depth=top).collect())
    want = []
    for i, t in rows:
        b, score = bytes(top) + (t or "").encode(), 0.0
        for at in range(top, len(b)):
            node = 1
            for k in range(7, -1, -1):
                one, bit = prob(b[at - top : at][::-1], node), b[at] >> k & 1
                score += math.log10(one if bit else 1 - one)
                node = node * 2 + bit
        want.append((i or -1, not t, score))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert np.allclose([x[2] for x in got], [x[2] for x in sorted(want)], rtol=1e-5)
    shallow = {r["doc_id"]: r["score"] for r in lm_score.score_documents(d).collect()}
    assert sum(x[2] > shallow[x[0]] for x in got if x[0] in shallow and not x[1]) > 20


# Decontamination
def edit_search(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_is_brute_forces(spark, odd, none):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "too short"), (None, "no id for this item here")]
    rows = odd_rows(odd) + [(70, "is this Too\nshort perhaps"), (None, "there is no id for this item here, nor for the text"), (71, "no id for that item here")]
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        part = items[rng.randrange(12)][1].split()
        for _ in range(rng.randint(0, 9)):
            k = rng.randrange(len(part))
            part[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary).upper()] * rng.randint(0, 1)
        rows.append((100 + i, " ".join(w[:20] + part + w[20:]) if i % 4 else " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in rows:
        for k, x in items:
            w = words(x)
            if w and (e := edit_search(w, words(t))) <= int(len(w) * 0.2):
                want.add((i, k, e))
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.contamination(d, b).collect()}
    assert got == want and any(e > 0 for _, _, e in want) and len(want) > 20
    judged = decontam.judge(d, b).collect()
    assert len(judged) == len(rows) and {(r["doc_id"], k) for r in judged for k in r["items"]} == {(i, k) for i, k, _ in want if k is not None}
    assert {r["doc_id"] for r in judged if r["contaminated"]} == {i for i, _, _ in want} > {None}
    assert decontam.judge(none, b).count() == 0 and decontam.judge(odd, b.where("false")).where("contaminated").count() == 0


def test_pieces_that_items_share(spark):
    items = spark.createDataFrame([(i, f"alpha beta gamma delta item{i}") for i in range(50)], "item_id long, text string")
    d = spark.createDataFrame([(7, "x alpha beta gamma delta item3 y"), (8, "alpha beta gamma " * 400), (9, "")], "doc_id long, text string")
    got = decontam.contamination(d, items).collect()
    assert {r["item_id"] for r in got if r["distance"] == 0} == {3} and len(got) == 50 and {r["doc_id"] for r in got} == {7}
    assert decontam.contamination(d, items, share=0.0).count() == 1


# Statistics and rules
def plain_stats(text):
    w = [x.decode() for x in words(text, lower=False)]
    text = text or ""
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics(odd, docs):
    both = odd.select("doc_id", "text").union(docs.select("doc_id", "text"))
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in stats.with_stats(both).collect())
    assert got == sorted((str(r["doc_id"]), *plain_stats(r["text"])) for r in both.collect())


def test_trees_are_monotone_and_right():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(1500, 3))
    y = ((x[:, 0] < 0.4) & (x[:, 1] > 0.2)).astype(float)
    t = quality_rules.fit_trees(x, y, np.array([-1, 0, 0]))
    assert ((t.score(x) > 0.5) == y).mean() > 0.97
    line = np.stack([np.linspace(0, 1, 200), np.full(200, 0.6), np.full(200, 0.5)], 1)
    assert (np.diff(t.raw(line)) <= 1e-12).all()
    one = np.array([t.raw(r[None])[0] for r in x[:50]])
    assert np.allclose(one, t.raw(x[:50]))
    assert quality_rules.fit_trees(x[:0], y[:0], np.zeros(3)).score(x[:2]).tolist() == [0.5, 0.5]


def test_rules(odd, none, labels, spark, docs):
    out = quality_rules.apply_rules(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality_rules.apply_rules(none, labels).count() == 0 and quality_rules.apply_rules(odd, labels.where("false")).where("score <> 0.5").count() == 0
    known = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.apply_rules(docs, known).join(known, "doc_id")
    assert got.where("verdict and quality = 0").count() + got.where("not verdict and quality = 1").count() <= 0.05 * got.count()


# Classifier
def test_classifier(odd, none, labels, spark):
    out = quality_classifier.classify(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in out)
    assert quality_classifier.classify(none, labels).count() == 0
    assert quality_classifier.classify(odd, labels.where("false")).where("score <> 0.5").count() == 0
    d = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{d}/labels.parquet")
    got = quality_classifier.classify(spark.read.parquet(f"{d}/documents.parquet"), known).join(known, "doc_id").where("held_out")
    assert got.where("predicted <> quality").count() <= 0.05 * got.count()


def test_isotonic():
    n, k = np.array([5.0, 5, 0, 5, 5]), np.array([1.0, 0, 0, 4, 3])
    level = quality_classifier.isotonic(n, k)
    assert (np.diff(level) >= 0).all() and level[0] == level[1] and level[3] == level[4]


def test_partition_sums_do_not_depend_on_partitions(odd, labels, spark):
    d = "/root/testdata/sf0.001"
    docs, known = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    a, b = (pd.DataFrame(quality_classifier.classify(docs.repartition(n), known).orderBy("doc_id").collect()) for n in (1, 7))
    assert np.allclose(a[2].astype(float), b[2].astype(float), atol=1e-6)


# Language
def test_language(odd, none, spark):
    out = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert out[3]["lang_pred"] == out[4]["lang_pred"] == out[5]["lang_pred"] == "und" and out[3]["score"] == 0
    assert {out[i]["lang_pred"] for i in (1, 6, 7, 10)} <= {"en", "fr"} and langid.identify(none).count() == 0
    assert langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert got.where("lang_pred <> lang").count() <= 0.02 * got.count()


# Urls
def plain_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(url_filter._UPPER, url_filter._LOWER)), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    link = lambda u: f'<html><head><link href="{u}" rel="canonical"></head>'
    jump = lambda u: f'<meta http-equiv="refresh" content="0; URL={u}">'
    rows = [
        (1, "http://A.example.ORG/es/x?q#f", ""), (2, "https://example.org", ""), (3, None, None), (4, "no scheme", link("http://x.com/de/1")), (5, "http://x.com/de/1", None),
        (6, "http://plain.net/a", link("http://x.com/de/1")), (7, "http://plain.net/b#part", jump("/a")), (8, "http://plain.net/c", link("http://only.example.org/en/12")), (8, "http://plain.net/c", ""),
        (9, "http://other.net/", jump("http://plain.net/d")), (10, "http://plain.net/d", link("http://good.org/p")), (11, "http://bad.net/", link("http://plain.net/d")), (12, "x://com/fr/", ""), (13, "http://acom/fr/", ""), (14, "http://z.com/de/é", link("http://good.org/p")), (15, "http://notexample.org/es/", ""),
    ]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as node")
    got = [tuple(r) for r in url_filter.judge(d).select("page_id", "host", "path", "rule", "verdict").collect()]
    verdict = {4: "allow", 6: "block", 7: "block", 8: "block", 9: "allow", 10: "allow", 11: "allow", 13: "allow", 3: "allow"}
    want = [(i, *(x := plain_url(u))[:3], x[3] or verdict.get(i, "allow")) for i, u, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    import duckdb

    db = duckdb.connect()
    db.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    sql = db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.OP7_SQL})").fetchall()
    assert sorted(sql, key=str) == sorted(got, key=str)
    assert url_filter.judge(d.where("false")).count() == 0
    more = spark.createDataFrame([("http://q.net/", "http://x.com/de/1")], "src string, dst string")
    one = spark.createDataFrame([(1, "http://q.net/", "")], "page_id long, url string, html string")
    assert url_filter.judge(one, redirects=more).first()["verdict"] == "block"


def test_forms_of_links(spark):
    meta = lambda content: f"<meta http-equiv=refresh content={content}>"
    to = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "http://x.com/de/1", "", "block"), (2, "http://x.com/fr/1", "", "allow"),
        # Quotes within the content, and content without quotes.
        (10, "http://n1.net/", meta("\"0;url='http://x.com/de/1'\""), "block"), (11, "http://n2.net/", meta("'0; URL=\"http://x.com/de/1\"'"), "block"),
        (12, "http://n3.net/", meta("0;url=http://x.com/de/1"), "block"), (13, "http://n4.net/", "<meta content=0;url=http://x.com/de/1 http-equiv=refresh>", "block"),
        # All links of a page count.
        (20, "http://n5.net/", to("http://n0.net/") + to("http://x.com/de/1"), "block"), (21, "http://n6.net/", meta('"5"') + meta('"0;url=http://n0.net/a"') + meta('"0;url=http://x.com/de/1"'), "block"),
        # Relative targets: bad.net/a/b/t, /a/t, /t and ?p=2 are aliases of a blocked page.
        (30, "http://bad.net/a/b/t", to("http://x.com/de/2"), "block"), (31, "http://bad.net/a/b/s", to("t"), "block"), (32, "http://bad.net/a/b/c/s?q", to("../t#f"), "block"),
        (33, "http://bad.net/a/b/c/d/", to("./../.././t"), "block"), (34, "http://bad.net/q/s", to("/a/x/../b/./t"), "block"), (35, "http://bad.net/p?p=2", to("http://x.com/de/3"), "block"),
        (36, "http://bad.net/p?p=1", to("?p=2"), "block"), (37, "http://bad.net", to("../a/b/t"), "block"), (38, "http://bad.net/r", to("a/b/t?u=http://x.com/de/1"), "allow"),
        (39, "http://bad.net/m", to("mailto:x@x.com"), "allow"), (40, "http://bad.net/de/9", to("de/9"), "allow"), (41, "http://bad.net/z", to("#top"), "allow"),
    ]
    d = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {(r["page_id"], r["verdict"]) for r in url_filter.judge(d).collect()} == {(r[0], r[3]) for r in rows}


# Mixing
def test_mixing(odd, none, docs):
    got = mixing.plan_mix(odd).select("doc_id", "text", "source", "__mix.*").collect()
    sizes = Counter()
    for r in got:
        assert r["size"] == len(words(r["text"])) and 0 <= r["copies"] <= 3
        sizes[r["source"]] += r["size"]
    assert all(r["source_size"] == sizes[r["source"]] for r in got)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    share, rest, free = {s: 0.0 for s in order}, float(sum(sizes.values())), set(order)
    while rest > 1e-9 and free:
        unit, left = rest / sum(weight[s] for s in free), 0.0
        for s in list(free):
            share[s] += unit * weight[s]
            if share[s] > 3 * sizes[s]:
                left += share[s] - 3 * sizes[s]
                share[s] = 3.0 * sizes[s]
                free.discard(s)
        rest = left
    assert all(math.isclose(r["target"], share[r["source"]], rel_tol=1e-9) for r in got)
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(odd).columns == odd.columns
    assert mixing.mix(odd).where("_size <> 'extra' or _mix <> 'extra' or _copy <> 'extra' or _source <> 'extra'").count() == 0
    assert mixing.mix(odd).count() == sum(r["copies"] for r in got) and mixing.mix(docs).exceptAll(mixing.mix(docs)).count() == 0


# Queries and pipeline
def test_registered_queries(spark):
    known = queries.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in known} == set(range(1, 11))
    assert set(queries.oracle_sql()) <= set(known)


def test_sql(spark):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        want, got = db.execute(sql).df(), queries.queries()[name](spark, SF).toPandas()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        text = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
        assert text(got) == text(want), name


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = {}
    for n, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, d).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        steps[name] = docs
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    a, b, c, m, t = steps.values()
    labels = spark.read.parquet(f"{d}/labels.parquet")
    assert a.join(labels, "doc_id").where("quality = 0").count() <= 4
    local = a.toPandas()
    kept = {i for i, _, root in linked(list(zip(local.doc_id, local.text)), 5) if i == str(root)}
    assert {str(r[0]) for r in b.select("doc_id").collect()} == kept
    items = [words(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in b.collect() if not any(b" ".join(w) in b" ".join(words(r["text"])) for w in items)}
    assert {r[0] for r in c.select("doc_id").collect()} == clean
    copies = Counter(r[0] for r in m.select("doc_id").collect())
    assert set(copies) <= clean and max(copies.values()) <= 3
    assert Counter(r[0] for r in t.select("doc_id").collect()) == copies


def test_pipeline_takes_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline as p

    odd.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert p.run(spark, str(tmp_path)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    for _, stage in p.STAGES[:-1]:
        got = stage(spark, odd, str(tmp_path))
        assert got.columns == odd.columns and got.where("_row <> 'extra' or _gone <> 'extra' or _mix <> 'extra'").count() == 0
        assert stage(spark, odd.where("false"), str(tmp_path)).count() == 0


def test_pipeline_acts_on_rows(spark, tmp_path):
    import corpus_pipeline as p

    item = "this benchmark item has quite a few words of its own to be found"
    copy = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, f"before {item} after"), (1, f"so {item} too"), (1, "clean text under the id of a contaminated one, rather long"), (None, copy), (5, copy), (5, copy), (6, copy + " thirteen"), (None, "a null id with clean words and no copies at all"), (7, None), (7, None), (None, "twins without ids are linked like any other texts"), (None, "twins without ids are linked like any other texts")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert got(p.decontaminated(spark, d, str(tmp_path))) == sorted(str(r) for r in rows if item not in (r[1] or ""))
    assert got(p.deduplicated(spark, d, "")) == sorted(map(str, rows[:3] + [rows[4]] + rows[7:11]))
    # The classifier's verdict takes effect on rows: prose without an id, and junk beside prose under one id.
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    mixed = docs.union(docs.selectExpr("cast(null as long)", "text")).union(docs.selectExpr("doc_id", "'' as text"))
    scores = quality_classifier.classify(mixed.selectExpr("*", "monotonically_increasing_id() as r"), labels, row_col="r")
    bad = scores.where("predicted = 0")
    assert bad.where("doc_id is null").count() > 0
    kept = p.quality(spark, mixed, SF)
    assert kept.count() == scores.where("predicted = 1").count()
    assert kept.where("doc_id is null").count() == scores.where("predicted = 1 and doc_id is null").count()


def test_pieces_and_runs():
    t = pa.array(["a", None, "bb" * 50, "", "c"])
    got = [(i, j, bytes(d), o.tolist()) for i, j, d, o in C.pieces(t, limit=10)]
    assert [x[:2] for x in got] == [(0, 2), (2, 3), (3, 5)] and got[0][2:] == (b"a", [0, 1, 1])
    b = [pa.RecordBatch.from_pydict({"k": x}) for x in ([1, 1, 2], [2, 2], [2, 3], [3])]
    assert [x["k"].to_pylist() for x in C.runs(iter(b), ["k"])] == [[1, 1], [2, 2, 2, 2], [3, 3]]


def test_hot_keys_are_dealt(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(90)], "component long, node long")
    values = rows.groupBy("component").agg(F.max("node").alias("top"))
    got = {tuple(r) for r in C.salted_join(rows, values, "component", "node").select("component", "node", "top").collect()}
    assert got == {tuple(r) for r in rows.join(values, "component").select("component", "node", "top").collect()} and len(got) == 90


def test_strings_hash_by_their_bytes():
    texts = ["", "a", "a\0", "\0a", "word", "12345678", "123456789", "1234567812345678", "x" * 1024, "x" * 1025, "x" * 5000, "é" * 700]
    data = np.frombuffer("".join([*texts, *texts]).encode(), np.uint8)
    end = np.cumsum([len(t.encode()) for t in [*texts, *texts]])
    h = C.string_hash(data, np.concatenate([[0], end[:-1]]), end)
    assert (h[: len(texts)] == h[len(texts) :]).all() and len(set(h.tolist())) == len(texts)


def test_row_groups_of_chunks_are_small(spark, monkeypatch):
    """However many chunks and groups of runs a task has, Spark reads a few of them at once (a row group)."""
    import pyarrow.parquet as pq

    groups = []

    def written(df, *args, **kw):
        out = write(df, *args, **kw)
        for f in pathlib.Path(out._polyfold_path.removeprefix("file://")).glob("*.parquet"):
            m = pq.ParquetFile(f).metadata
            groups.extend((tuple(df.columns), m.row_group(i).num_rows, m.row_group(i).total_byte_size) for i in range(m.num_row_groups))
        return out

    write = C.written
    monkeypatch.setattr(C, "written", written)
    docs = spark.range(0, 6, 1, 1).selectExpr("id as doc_id", "repeat(concat('some words of text ', id, ' '), 430000) as text")
    assert lm_score.score_documents(docs, depth=3).count() == 6
    assert sum(n for c, n, _ in groups if "vocab" in c) == 6
    assert max(n for c, n, _ in groups if "text" in c or "runs" in c) <= 4
    assert max(size for _, _, size in groups) < 40 << 20


def test_blocks_of_a_segment_advance_together(monkeypatch):
    """No few blocks are left over for a round of steps of their own, and the bytes don't depend on the rounds."""
    rounds, encode, decode = [], token_coder._encode, token_coder._decode
    monkeypatch.setattr(token_coder, "_encode", lambda ids, *x: rounds.append(ids.shape[1]) or encode(ids, *x))
    monkeypatch.setattr(token_coder, "_decode", lambda words, *x: rounds.append(len(words)) or decode(words, *x))
    monkeypatch.setattr(token_coder, "BLOCK", 4)
    ids = np.random.default_rng(5).integers(0, 50, 4 * 5121 - 3).astype(np.uint16)
    for n, want in ((4 * 4300, [4300, 4300]), (len(ids), [2561, 2560, 2561, 2560]), (0, []), (1, [1, 1])):
        rounds.clear()
        coded = token_coder.encode_segment(ids[:n])
        assert (token_coder.decode_segment(coded) == ids[:n]).all() and rounds == want
        monkeypatch.setattr(token_coder, "LANES", 700)
        assert token_coder.encode_segment(ids[:n]) == coded
        monkeypatch.setattr(token_coder, "LANES", 5120)
