"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyfold.llm import decontam, langid, lm_score, mixing, near_dedup, quality_classifier, quality_rules, suffix_dedup, token_output, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(_table(spark, sf_dir, "documents"), length=200)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(_table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"), depth=4)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("verdict")).alias("kept"), "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).drop("alias_of")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    m = F.col(out.columns[-1])
    return out.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * m["copies"]).alias("taken"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_suffix_dedup, op3_token_output, op4_lm_score, op5_decontamination, op6_quality_rules, op7_url_filter, op8_mixing, op9_language_id, op10_quality_classifier)}


#: Shingle sets are joined with each other; links are followed in both directions.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(t) < 2 THEN t ELSE list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component, doc_id) AS component_id, coalesce(m.component, doc_id) = doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = doc_id
"""

#: All windows of all texts.
OP2_SQL = r"""
WITH b AS (SELECT row_number() OVER () AS n, doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT n, p, array_slice(x, p, p + 199) AS s FROM (SELECT n, x, unnest(range(1, octet_length(x) - 198)) AS p FROM b)),
h AS (SELECT n, p, coalesce(p > lag(p) OVER (PARTITION BY n ORDER BY p) + 200, true) AS new FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
g AS (SELECT n, p, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY n ORDER BY p) AS k FROM h),
r AS (SELECT n, k, min(p) AS a, max(p) + 200 AS e FROM g GROUP BY n, k),
q AS (SELECT n, a, e, coalesce(lag(e) OVER (PARTITION BY n ORDER BY a), 1) AS from_ FROM r),
c AS (SELECT n, CAST(sum(e - a) AS BIGINT) AS removed, count(*) AS spans, max(e) AS last, string_agg(CASE WHEN a > from_ THEN hex(array_slice(x, from_, a - 1)) ELSE '' END, '' ORDER BY a) AS head FROM q JOIN b USING (n) GROUP BY n)
SELECT doc_id, octet_length(x) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
 sha256(CASE WHEN removed IS NULL THEN x ELSE unhex(head || CASE WHEN last <= octet_length(x) THEN hex(array_slice(x, last, octet_length(x))) ELSE '' END) END) AS kept_sha256
FROM b LEFT JOIN c USING (n)
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, CAST(3.0 AS DOUBLE) * source_size AS cap FROM r),
o AS (SELECT *, cap / w AS stop FROM w),
l AS (SELECT *, row_number() OVER (ORDER BY stop, rank) AS k,
 (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY stop, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
 / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY stop, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
f AS (SELECT arg_min(level, k) AS level FROM l WHERE level <= stop),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM f), 0) * w) AS target FROM l),
j AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0::DOUBLE END AS rate,
 CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""


_REL, _HREF = r"""rel\s*=\s*["']?canonical\b""", r"""href\s*=\s*["']?([^"'\s>]+)"""
_EQUIV, _CONTENT = r"""http-equiv\s*=\s*["']?refresh\b""", r"""content\s*=\s*["'][^"']*?url\s*=\s*([^"'\s>]+)"""


def _found(tag: str, a: str, b: str) -> str:
    """SQL for the link in a tag that has both attributes, in either order."""
    one, two = (f"regexp_extract(coalesce(html, ''), '{x}', 1)" for x in (rf"(?is)<{tag}\b[^>]*\b{a}[^>]*\b{b}".replace("'", "''"), rf"(?is)<{tag}\b[^>]*\b{b}[^>]*\b{a}".replace("'", "''")))
    return f"CASE WHEN {one} <> '' THEN {one} ELSE {two} END"


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)


def _host_path(url: str) -> str:
    return rf"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path"


def _key(url: str) -> str:
    u = f"regexp_replace({url}, '#.*$', '')"
    head = f"regexp_extract({u}, '(?s)^.*?://[^/?]*')"
    return f"translate({head}, {_AZ}) || substr({u}, length({head}) + 1)"


OP7_SQL = rf"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {_RULES}),
p AS (SELECT row_number() OVER () AS n, page_id, url, {_host_path("url")}, CASE WHEN instr(url, '://') > 0 THEN {_key("url")} END AS node FROM pages),
own AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM (SELECT p.n, r.* FROM p, rules r WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) GROUP BY n),
t AS (SELECT url, regexp_extract(url, '^([^:/?#]+)://', 1) AS scheme, {_host_path("url")}, replace(unnest([{_found("link", _REL, _HREF)}, {_found("meta", _EQUIV, _CONTENT)}]), '&amp;', '&') AS t FROM pages WHERE instr(url, '://') > 0),
e AS (SELECT url AS src, CASE WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN scheme || '://' || host || t ELSE t END AS dst FROM t),
ends AS (SELECT src AS url FROM e WHERE instr(dst, '://') > 0 UNION SELECT dst FROM e WHERE instr(dst, '://') > 0),
links AS (SELECT {_key("src")} AS a, {_key("dst")} AS b FROM e WHERE instr(dst, '://') > 0),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON x.a = r.b),
heard AS (SELECT node, arg_max(v, length(h || p)) AS v FROM (SELECT x.node, x.url, r.* FROM (SELECT url, {_key("url")} AS node, {_host_path("url")} FROM ends) x, rules r WHERE (x.host = r.h OR ends_with(x.host, '.' || r.h)) AND starts_with(x.path, r.p)) GROUP BY node, url),
said AS (SELECT reach.a AS node, min(heard.v) AS v FROM reach JOIN heard ON heard.node = reach.b GROUP BY reach.a)
SELECT p.page_id, p.host, p.path, own.rule, coalesce(own.v, said.v, 'allow') AS verdict FROM p LEFT JOIN own USING (n) LEFT JOIN said ON said.node = p.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": OP1_SQL, "op2_suffix_dedup": OP2_SQL, "op7_url_filter": OP7_SQL, "op8_mixing": OP8_SQL}
