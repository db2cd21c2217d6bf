"""The registered queries over a small folder of tables, held against plain Python."""

import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from polyfold.llm import common as C
from polyfold.llm import langid, lm_score, near_dedup, quality_classifier, quality_rules, queries, stats, token_output
from test_llm import WORDS, edit_search, fold, linked, odd_rows, plain_stats, plain_url, repeats, words


def thue_morse():
    """Two words of 1024 letters that polynomial hashes modulo a power of two can't tell apart."""
    t = "a"
    for _ in range(10):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.randint(5, 30))) for i in range(8)] + [(None, "an item without any id at all"), (90, None), (91, "two words")]
    passage = prose(80)
    rows = [(*r[:4],) for r in odd_rows(odd)]
    docs = [(i, t, ("en", "fr")[(i or 0) % 2], None) for i, t in rows]
    for i in range(60):
        text = prose(rng.randrange(90))
        if i % 5 == 0:
            part = items[rng.randrange(8)][1].split()
            part[rng.randrange(len(part))] = "changed"
            text += " " + " ".join(part) + " " + prose(9)
        if i % 7 == 0:
            text = passage[rng.randrange(30) :] + text
        if i % 9 == 0:
            text = docs[-1][1] + " tail" if docs[-1][1] else text
        if i % 11 == 0:
            text += "\nline\nline\n# $ %\n" + "again and again and " * 6
        docs.append((100 + i, text, rng.choice(["en", "fr", "de", None]), rng.choice(["a", "b", "b", "b", None])))
    docs += [(200 + i, t, "en", "c") for i, t in enumerate(thue_morse())] + [(210, " ".join(thue_morse()), "en", "c"), (211, "\n".join([*thue_morse(), thue_morse()[0]]), "en", "c")]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    known = [(d[0], int(len(d[1] or "") > 200), 0) for d in docs if d[0] is not None]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(1, "http://A.org/es/x", None), (2, None, "x"), (3, "http://q.com/de/1", ""), (4, "http://n.net/", '<link rel="canonical" href="http://q.com/de/1">'), (4, "no url", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at, [d[:2] for d in docs], items


@pytest.fixture(scope="module")
def result(spark, folder):
    return lambda name: queries.queries()[name](spark, folder[0]).collect()


def test_op1(folder, result):
    got = result("op1_near_dedup")
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == linked(folder[1], 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_op2(folder, result):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in result("op2_suffix_dedup"))
    assert got == sorted((str(i), *x) for (i, _), x in zip(folder[1], repeats([(t or "").encode() for _, t in folder[1]])))
    assert any(r[2] > 0 for r in got)


def test_op3(folder, result):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_output.default_tokenizer())
    want = Counter()
    for i, t in folder[1]:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = sorted(result("op3_token_output"), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in folder[1]), key=lambda x: (x is not None, x or 0))


def test_op4(folder, result):
    """Counts and the base in plain Python; the score against a plain walk of the tree for short texts is in test_llm."""
    rows = folder[1]
    counts = Counter(w for i, t in rows if fold(i, 5) != 1 for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    got = {(r["doc_id"], r["n_tokens"], r["n_known"]): r for r in result("op4_lm_score")}
    for i, t in rows:
        w = [*words(t), None]
        r = got[i, len(w), sum(counts[x] > 0 for x in w)]
        assert r["held_out"] == (fold(i, 5) == 1) and r["train_tokens"] == n
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] <= 0


def test_op5(folder, result):
    _, rows, items = folder
    best: dict = {}
    for i, t in rows:
        for k, x in items:
            w = words(x)
            if w and (e := edit_search(w, words(t))) <= int(len(w) * 0.2):
                best.setdefault(i, []).append((k, e))
    got = result("op5_decontamination")
    assert len(got) == len(rows) and len(best) > 5
    for r in got:
        mine = best.get(r["doc_id"], [])
        assert r["contaminated"] == bool(mine) and r["items"] == sorted({k for k, _ in mine if k is not None}) and r["distance"] == min((e for _, e in mine), default=None)


def features_of(t):
    b = np.frombuffer((t or "").encode(), np.uint8)
    return stats.document_stats(b, np.array([0, len(b)]))["features"][0].tolist()


def test_op6(spark, folder, result):
    """Each tree is walked node by node."""
    at, rows, _ = folder
    d, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    trees = quality_rules.learn_rules(stats.with_stats(d), labels)

    def odds(x):
        total = trees.base
        for node in trees.roots:
            while trees.feature[node] >= 0:
                node = trees.left[node] if x[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return total

    want = Counter()
    for i, t in rows:
        n, *base = plain_stats(t)
        failed = n < 10 or 100 * base[-1] > 20 * n
        want[(i, n, *base, failed, not failed and odds(features_of(t)) >= 0)] += 1
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert Counter(tuple(r[c] for c in cols) for r in result("op6_quality_rules")) == want
    assert {x[-1] for x in want} == {True, False} and len(trees.roots) > 5


def test_op7(result):
    want = {1: ("allow", "org/"), 2: ("allow", None), 3: ("block", "com/de/"), 4: ("block", None)}
    for r in result("op7_url_filter"):
        if r["page_id"] == 4 and not r["host"]:
            continue  # the row without a url
        assert (r["verdict"], r["rule"]) == want[r["page_id"]]
    assert sorted((r["host"], r["path"]) for r in result("op7_url_filter")) == sorted(plain_url(u)[:2] for u in ("http://A.org/es/x", None, "http://q.com/de/1", "http://n.net/", "no url"))


def test_op8(spark, folder, result):
    d = spark.read.parquet(f"{folder[0]}/documents.parquet").select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in d:
        sizes[r["source"]] += len(words(r["text"]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, rest, free = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while rest > 1e-9 and free:
        unit, rest = rest / sum(weight[s] for s in free), 0.0
        for s in list(free):
            target[s] += unit * weight[s]
            if target[s] >= 3 * sizes[s]:
                rest += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                free.discard(s)
    want = []
    for r in d:
        n, s = len(words(r["text"])), r["source"]
        rate = min(target[s] / sizes[s], 3.0) if sizes[s] else 0.0
        u = int(__import__("hashlib").md5(f"mix-1:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        want.append((str(r["doc_id"]), n, sizes[s], round(target[s], 6), n * (int(rate + 1e-12) + (u < rate - int(rate + 1e-12)))))
    got = [(str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in result("op8_mixing")]
    assert sorted(got) == sorted(want)


def test_op9(spark, folder, result):
    """Subwords are hashed one by one and the softmax is summed up in plain Python."""
    at, rows, _ = folder
    model = langid.learn(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text", "lang"))
    got = {(r["doc_id"], round(r["score"], 6)): r for r in result("op9_language_id")}
    assert set(model.labels) == {"en", "fr", "de"}
    for i, t in rows:
        b = [x if x >= 128 else x | 32 if 65 <= x & ~32 <= 90 else 32 for x in (t or "").encode()]
        counts = Counter()
        for k in (3, 4):
            for p in range(len(b) - k + 1):
                if b[p] == 32 == b[p + 1]:
                    continue
                g = int.from_bytes(bytes(b[p : p + k]), "big") & 0xFFFFFFFF
                counts[((g * 2654435761 & 0xFFFFFFFF) ^ (k * 0x51ED27 & 0xFFFFFFFF)) * 0x85EBCA6B % 2**32 >> 20] += 1
        n = max(sum(counts.values()), 1)
        z = [(sum(c * model.table[x, j] for x, c in counts.items()) / n + model.bias[j]) / model.temperature for j in range(3)]
        e = [math.exp(x - max(z)) for x in z]
        letters = any(map(str.isalpha, t or ""))
        score, lang = (max(e) / sum(e), model.labels[e.index(max(e))]) if letters else (0.0, "und")
        r = next(r for (d, s), r in got.items() if d == i and abs(s - score) < 1e-5)
        assert r["lang_pred"] == lang and r["held_out"] == (fold(i, 4) == 2)


def test_op10(spark, folder, result):
    """Fourier features and calibration in plain Python."""
    at, rows, _ = folder
    d, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    m = quality_classifier.fit(stats.with_stats(d).select("doc_id", "features"), labels)
    k = m.kernel
    got = result("op10_quality_classifier")
    for i, t in rows:
        z = [min(6, max(-6, (x - a) / s)) for x, a, s in zip(features_of(t), k.mean, k.scale)]
        f = [math.cos(sum(z[a] * k.w[a, j] for a in range(len(z))) + k.b[j]) * math.sqrt(2 / k.w.shape[1]) for j in range(k.w.shape[1])] + [x / 6 for x in z] + [1.0]
        raw = sum(a * b for a, b in zip(f, m.theta))
        pos = min(1, max(0, (raw - m.low) / (m.high - m.low))) * len(m.levels) - 0.5
        low = min(max(int(math.floor(pos)), 0), len(m.levels) - 1)
        high = min(low + 1, len(m.levels) - 1)
        part = min(max(pos - low, 0), 1)
        score = min(1, max(0, m.levels[low] * (1 - part) + m.levels[high] * part))
        r = min((r for r in got if r["doc_id"] == i), key=lambda r: abs(r["score"] - score))
        assert abs(r["score"] - score) < 1e-6 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (fold(i, 4) == 2)
    assert len(got) == len(rows)


# Words that a hash modulo a power of two can't tell apart
def test_hashes_tell_thue_morse_words_apart():
    t, u = thue_morse()
    data = np.frombuffer((t + u).encode(), np.uint8)
    s = C.prefix(data)
    for n in (16, 64, 256, 1024):
        h = C.span_hash(s, np.array([0, 1024]), np.array([n, 1024 + n]))
        assert h[0] != h[1] and h[0] == C.window_hash(s, n)[0]


def test_operators_tell_them_apart(spark):
    from tokenizers import Tokenizer

    t, u = thue_morse()
    held = next(i for i in range(1, 50) if fold(i, 5) == 1)
    d = spark.createDataFrame([(0, t), (held, u), (60, f"{t}\n{u}\n{t}")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(d, k=2).collect()} == {0: 0, held: held, 60: 60}
    library = Tokenizer.from_file(token_output.default_tokenizer())
    for r in token_output.token_files(d).collect():
        text = {0: t, held: u, 60: f"{t}\n{u}\n{t}"}[r["doc_id"]]
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids.tobytes())
    one = spark.createDataFrame([(0, t), (held, u)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_known"] for r in lm_score.score_documents(one).collect()} == {0: 2, held: 1}
    assert {r["doc_id"]: r["n_dup_lines"] for r in stats.with_stats(d).collect()} == {0: 0, held: 0, 60: 1}


def test_a_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        C.scratch_dir(Session())


def test_scratch_tables_go(spark, folder):
    before = set(C._left)
    out = C.finished(lambda: queries.op1_near_dedup(spark, folder[0]), spark)
    assert set(C._left) - before == {out._polyfold_path} and out.count() == len(folder[1])
    C.discard(out)
    assert set(C._left) == before


def test_rare_languages_are_learned(spark):
    rows = [(i, "some common words of a text", "en") for i in range(400)] + [(1000 + i, "quelques mots rares", "fr") for i in range(2)] + [(2000, "wort", "de")]
    d = spark.createDataFrame([r for r in rows if fold(r[0], 4) != 2 or r[2] == "en"] + [(5000 + i, "noch ein wort", "de") for i in range(4)], "doc_id long, text string, lang string")
    assert {"en", "de"} <= set(langid.learn(d, sample_rows=20).labels)
