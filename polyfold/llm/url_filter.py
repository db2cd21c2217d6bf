"""URL filters with redirect equivalence.

Rules fit a host with its subdomains and a path prefix; the longest that fits decides a url. Redirects and
canonical links make urls aliases: connected components over those edges carry decisions to urls without a
rule of their own. An explicit allow of any alias comes before a block of another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyfold.llm import common as C

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Targets in pages: canonical links, and the contents of refreshes (quotes included), either attribute order.
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*("[^">]*|'[^'>]*|[^"'\s>][^\s>]*)"""
#: The target in a refresh's content, quoted or not.
JUMP = r"""(?is)url\s*=\s*["']?\s*([^"'\s>]+)"""


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ://."""
    u = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    return F.translate(F.regexp_extract(u, pattern, 1), _UPPER, _LOWER), F.regexp_extract(u, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def node_key(url: Column) -> Column:
    """What aliases are told apart by: scheme and host in lower case, without the fragment."""
    u = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(u, r"(?s)^.*?://[^/?]*", 0)
    return F.concat(F.translate(head, _UPPER, _LOWER), F.substring(u, F.length(head) + 1, F.length(u)))


def _plain(path: Column) -> Column:
    """A path from / on without its segments . and .. ."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    out = F.array_join(kept, "/")
    return F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(out, F.lit("/"))).otherwise(out)


def absolute(target: Column, host: Column, path: Column, url: Column) -> Column:
    """A link's target as a whole url, resolved against the page's; null for other schemes (mailto:x)."""
    scheme = F.regexp_extract(url, r"^([^:/?#]+)://", 1)
    t = F.replace(target, F.lit("&amp;"), F.lit("&"))
    own, page = F.regexp_extract(t, r"(?s)^([^?#]*)", 1), F.when(path == "", F.lit("/")).otherwise(path)
    at = F.concat(scheme, F.lit("://"), host)
    rest = F.substring(t, F.length(own) + 1, F.length(t))
    whole = F.when(own == "", page).when(own.startswith("/"), _plain(own)).otherwise(_plain(F.concat(F.regexp_extract(page, r"(?s)^(.*/)", 1), own)))
    query = F.when((own == "") & rest.startswith("#"), F.regexp_extract(url, r"(?s)(\?[^#]*)", 1)).otherwise(F.lit(""))
    return F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), t).when(t.startswith("//"), F.concat(scheme, F.lit(":"), t)).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None).otherwise(F.concat(at, whole, query, rest))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst: the urls of pages and the targets of all their canonical links and refresh redirects."""
    url, html = pages[url_col], F.coalesce(pages[html_col], F.lit(""))
    jumps = F.transform(F.regexp_extract_all(html, F.lit(REFRESH), 1), lambda x: F.regexp_extract(x, JUMP, 1))
    found = F.concat(F.regexp_extract_all(html, F.lit(CANONICAL), 1), jumps)
    e = pages.select(url.alias("src"), F.explode(found).alias("target")).where("target <> '' and src is not null and instr(src, '://') > 0")
    host, path = host_path(F.col("src"))
    return e.select("src", absolute(F.col("target"), host, path, F.col("src")).alias("dst")).where("instr(dst, '://') > 0")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and alias_of (a number that aliases share, null without aliases) of every row.

    redirects adds edges (src, dst) to those found in the pages. A url's own rule decides it. Else an allowed
    alias makes it allow, a blocked alias block, and it is allow otherwise. Null urls and urls without :// have
    empty host and path, no rule and no aliases: allow. Null or empty html has no links; very long html is searched
    whole. Of rules of one length the last by name wins. Repeated rows are judged alike. An empty table gives an empty table.
    Other columns are not read. Urls are numbered, not hashed, so no two share a node.
    """
    spark = pages.sparkSession
    host, path = host_path(pages[url_col])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("own", verdict)
    own = own.withColumn("key", F.when(F.instr("url", "://") > 0, node_key(F.col("url"))))
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst").where("instr(src, '://') > 0 and instr(dst, '://') > 0"))
    edges = edges.select("src", "dst", node_key(F.col("src")).alias("a"), node_key(F.col("dst")).alias("b"))
    edges = C.written(edges.where("a <> b").distinct(), spark)
    # Explicit decisions on any url of a component, pages or mere targets: allow sorts before block.
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("src").alias("url")), F.struct(F.col("b").alias("key"), F.col("dst").alias("url")))).alias("x")).select("x.*")
    h, p = host_path(F.col("url"))
    ends = ends.withColumn("host", h).withColumn("path", p).withColumn("own", rule_of(F.col("host"), F.col("path"), rules)[1])
    nodes = C.written(ends.groupBy("key").agg(F.min("own").alias("own")).withColumn("node", F.monotonically_increasing_id()), spark)
    number = lambda c: nodes.select(F.col("key").alias(c), F.col("node").alias("n" + c))
    comps = C.components(edges.join(number("a"), "a").join(number("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")), spark)
    placed = nodes.join(comps, "node")
    said = placed.groupBy("component").agg(F.min("own").alias("said"))
    alias = C.salted_join(placed.select("key", "component"), said, "component", "key").select("key", F.col("component").alias("alias_of"), "said")
    out = own.join(alias, "key", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "said", F.lit("allow")).alias("verdict"), "alias_of")
