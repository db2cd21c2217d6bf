"""Queries over documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyfold.functions import filters as P
from polyfold.functions import vector as V
from polyfold.operators import docs, vectors
from polyfold.plans.registry import query, table

# Words of the tables; the texts are invented prose.
WORD, OTHER, RARE, PREFIX = "tion", "thing", "eux", "thea"


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.to_json(F.struct("text", "lang", "source", "n_chars")).alias("body"))


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    return docs.flatten_columns(table(spark, d, "documents"), "doc_id", {"text": F.col("text"), "source": F.col("source")})


def _index(spark: SparkSession, d: str) -> DataFrame:
    return docs.index_rows(_leaves(spark, d), stem=False)


def _search(spark: SparkSession, d: str, text: str, **options) -> DataFrame:
    return docs.full_text(_index(spark, d), text, stem=False, **options).select("id", F.round("score", 6).alias("score"))


_LEAVES = "(SELECT doc_id AS id, 'text' AS field_path, text AS c FROM documents WHERE length(trim(text)) > 0 UNION ALL SELECT doc_id, 'source', source FROM documents WHERE length(trim(source)) > 0)"
_TOKENS = rf"(SELECT id, field_path, regexp_extract_all(lower(strip_accents(c)), '[\p{{L}}\p{{N}}]+') AS tokens FROM {_LEAVES})"


def _bm25(phrases: list[str], where: str, on: str = "") -> str:
    """phrases: SQL for the number of hits of each phrase in the list tokens."""
    counts = ", ".join(f"{p} AS f{i}" for i, p in enumerate(phrases))
    rows = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(phrases)))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END"
    score = " ".join(f"- ({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(phrases)))
    return f"WITH t AS (SELECT id, field_path, CAST(len(tokens) AS DOUBLE) AS dl, {counts} FROM {_TOKENS}), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {rows} FROM t) SELECT id, round(min(0 {score}), 6) AS score FROM t, s WHERE ({where}) {on} GROUP BY id"


def _term(w: str) -> str:
    return f"CAST(len(list_filter(tokens, lambda x: x = '{w}')) AS DOUBLE)"


def _prefix(w: str) -> str:
    return f"CAST(len(list_filter(tokens, lambda x: starts_with(x, '{w}'))) AS DOUBLE)"


def _phrase(a: str, b: str) -> str:
    return f"CAST(len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = '{a}' AND tokens[i + 1] = '{b}')) AS DOUBLE)"


@query("SELECT doc_id AS id, text FROM documents WHERE doc_id IN (3, 5, 8)")
def docs_get_many(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([(3,), (5,), (8,), (-1,)], "id long")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids), "id", "left_semi")


@query("SELECT doc_id AS id FROM documents WHERE lang = 'en' AND n_chars > 2000 ORDER BY source DESC, n_chars ASC, doc_id LIMIT 25 OFFSET 5")
def docs_where_sort_page(spark: SparkSession, d: str) -> DataFrame:
    return docs.DocumentQuery(_bodies(spark, d)).where(P.q("lang") == "en", P.q("n_chars") > 2000).sort(source="DESC", n_chars="ASC").limit(25).offset(5).frame().select("id")


@query("SELECT doc_id AS id, n_chars FROM documents WHERE n_chars >= 500 AND lang <> 'en'")
def docs_where_typed(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.where(P.typed_condition([P.q("n_chars") >= 500, P.q("lang") != "en"], {"n_chars": t["n_chars"], "lang": t["lang"]})).select(F.col("doc_id").alias("id"), "n_chars")


@query("SELECT doc_id AS id, field_path, c AS field_content FROM (SELECT doc_id, 'text' AS field_path, text AS c FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents) WHERE length(trim(c, ' \t\n\r\f\v')) > 0")
def docs_flatten(spark: SparkSession, d: str) -> DataFrame:
    return docs.flatten(_bodies(spark, d))


@query("SELECT count(*) AS n FROM documents")
def docs_count(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d).agg(F.count("*").alias("n"))


@query(_bm25([_term(WORD)], "f0 > 0"))
def docs_fts_term(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, WORD)


@query(_bm25([_term("the"), _term(OTHER)], "f0 > 0 AND f1 > 0"))
def docs_fts_and(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, f"the {OTHER}")


@query(_bm25([_term(WORD), _term(RARE)], "f0 > 0 OR f1 > 0"))
def docs_fts_or(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, f"{WORD} OR {RARE}")


@query(_bm25([_term(WORD), _term(OTHER)], "f0 > 0 AND NOT f1 > 0"))
def docs_fts_not(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, f"{WORD} NOT {OTHER}")


@query(_bm25([_phrase("of", "the")], "f0 > 0"))
def docs_fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, '"of the"')


@query(_bm25([_prefix(PREFIX)], "f0 > 0"))
def docs_fts_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, f"{PREFIX}*")


@query(_bm25([_term("src3")], "f0 > 0", "AND field_path IN ('source')"))
def docs_fts_on(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "src3", on=["source"])


@query(f"SELECT * FROM ({_bm25([_term('the'), _term(OTHER), _phrase('of', 'the'), _prefix(PREFIX)], 'f0 > 0 AND (f1 > 0 OR f2 > 0 OR f3 > 0)')}) ORDER BY score, id LIMIT 20")
def docs_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, f'the AND ({OTHER} OR "of the" OR {PREFIX}*)').orderBy("score", "id").limit(20)


@query(_bm25([_term("the"), _term(OTHER)], "f0 > 0 AND f1 > 0"))
def docs_fts_postings(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return docs.full_text(index, f"the {OTHER}", stem=False, post=docs.postings(index)).select("id", F.round("score", 6).alias("score"))


def _forms(*words: str) -> str:
    """Words of one stem; DuckDB has no stemmer here."""
    return f"CAST(len(list_filter(tokens, lambda x: x IN ({', '.join(map(repr, words))}))) AS DOUBLE)"


@query(_bm25([_forms("thing", "things", "thinge", "thinges", "thinged", "thinging", "thingful", "thingness"), _forms("nation", "nations", "national")], "f0 > 0 OR f1 > 0"))
def docs_fts_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """With Porter stems, as the index is by default; tests hold it against SQLite's full-text search as well."""
    return docs.full_text(docs.index_rows(_leaves(spark, d)), "things OR nations").select("id", F.round("score", 6).alias("score"))


@query("SELECT p_partkey AS id, CAST(len(list_filter(['sma', 'mal', 'all', 'll ', 'l r', ' ri', 'rin', 'ing'], lambda g: contains(lower(p_name), g))) AS DOUBLE) AS score FROM part WHERE score > 0")
def docs_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    leaves = docs.flatten_columns(table(spark, d, "part"), "p_partkey", {"name": F.col("p_name")})
    return docs.fuzzy(docs.trigram_rows(leaves), "small ring")


@query(f"WITH f AS ({_bm25([_term(WORD)], 'f0 > 0')}) SELECT id, score, quality FROM f JOIN labels ON doc_id = id WHERE quality = 1")
def fts_join_filter(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, WORD).join(table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), "quality"), "id")


@query("WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents) SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT * FROM b WHERE rank <= 50) GROUP BY id")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    one = lambda *order: t.orderBy(*order).limit(50).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return docs.rerank([one(F.col("n_chars").desc(), F.col("id")), one(F.col("id"))]).withColumn("score", F.round("score", 6))


@query("SELECT p_partkey, p_name, CAST(levenshtein(p_name, (SELECT p_name FROM part WHERE p_partkey = 1)) AS INTEGER) AS distance FROM part WHERE distance <= 8")
def docs_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name")
    name = p.where("p_partkey = 1").first()
    return docs.levenshtein(p, F.col("p_name"), name["p_name"] if name else "", 8)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.concat(F.lit('{"label":'), F.col("label").cast("string"), F.lit("}")).alias("metadata"))


def _probe(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


_V = "(SELECT e.vec_id AS item_id, e.label, CAST(e.embedding AS DOUBLE[]) AS v, CAST(q.embedding AS DOUBLE[]) AS q FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
_COS = "greatest((1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)) + 1e-10)) / 2, 0)"


def _vec_sql(score: str, where: str = "true") -> str:
    return f"SELECT item_id, round({score}, 6) AS score FROM {_V} WHERE {where} ORDER BY {score}, item_id LIMIT 10"


def _near(spark: SparkSession, d: str, **options) -> DataFrame:
    return vectors.near(_vectors(spark, d), _probe(spark, d), 10, **options).select("item_id", F.round("score", 6).alias("score"))


@query(_vec_sql(_COS))
def vec_near_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d)


@query(_vec_sql("list_distance(v, q)"))
def vec_near_euclid(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, metric="euclid")


@query(_vec_sql("list_sum(list_transform(list_zip(v, q), lambda x: abs(x[1] - x[2])))"))
def vec_near_manhattan(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, metric="manhattan")


@query(_vec_sql("1 - list_dot_product(v, q)").replace("round(1 -", "round(greatest(0, 1 -").replace(", 6)", "), 6)", 1))
def vec_near_custom(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.near(_vectors(spark, d), _probe(spark, d), 10, metric=lambda m, v: 1 - m.astype(float) @ v.astype(float))
    return out.select("item_id", F.round("score", 6).alias("score"))


@query(_vec_sql(_COS, "label = 3"))
def vec_near_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, filters=[P.q("label") == 3])


@query(_vec_sql(_COS, "item_id IN (4, 8, 15, 16, 23, 42)"))
def vec_near_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, candidate_ids=[4, 8, 15, 16, 23, 42])


def _planes_sql() -> str:
    planes = V.hyperplanes(64)
    bits = " + ".join(f"CASE WHEN list_dot_product(v, [{', '.join(repr(float(x)) for x in p)}]::DOUBLE[]) > 0 THEN {1 << (len(planes) - 1 - i)} ELSE 0 END" for i, p in enumerate(planes))
    return f"SELECT vec_id, CAST({bits} AS INTEGER) AS bucket FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(_planes_sql())
def vec_lsh_buckets(spark: SparkSession, d: str) -> DataFrame:
    return vectors.with_bucket(_vectors(spark, d), V.hyperplanes(64)).select(F.col("item_id").alias("vec_id"), "bucket")


@query()
def vec_near_lsh(spark: SparkSession, d: str) -> DataFrame:
    """Approximate, on vectors without clusters: vec_lsh_recall measures its recall."""
    planes = V.hyperplanes(64)
    return vectors.near(vectors.with_bucket(_vectors(spark, d), planes), _probe(spark, d), 10, method="lsh", planes=planes, radius=9)


@query("SELECT 10 AS k, true AS reached")
def vec_lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index finds at least nine of the ten nearest rows, by the exact scan, averaged over ten probes."""
    planes = V.hyperplanes(64)
    v = vectors.with_bucket(_vectors(spark, d), planes)
    found = None
    for r in v.where("item_id < 10").select("item_id", "vector").collect():
        near, exact = (vectors.near(v, list(r["vector"]), 10, method=m, planes=planes, radius=9).select("item_id") for m in ("lsh", "exact"))
        one = near.join(exact, "item_id", "left_semi").agg(F.count("*").alias("n"))
        found = one if found is None else found.union(one)
    return found.agg(F.lit(10).alias("k"), (F.avg("n") >= 9).alias("reached"))


@query(f"SELECT query_id, item_id, round(score, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, s AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY s, b.vec_id) AS r FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a, embeddings b, LATERAL (SELECT (1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) / 2 AS s)) WHERE r <= 10")
def vec_near_each(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 20 against all rows."""
    v = _vectors(spark, d)
    queries = v.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vector")
    return vectors.near_each(v, queries, 10).withColumn("score", F.round("score", 6))
