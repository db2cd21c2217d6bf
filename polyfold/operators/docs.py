"""Documents: full-text (BM25), trigram and filter search. Rows: id, body (JSON text).

The full-text index has a row for each document and field: id, field_path, tokens (folded words, stemmed by
default), length. It can be kept as a table; postings() is its inverted form, clustered by term for pruning.
"""

from __future__ import annotations

import asyncio
import json
from collections.abc import AsyncIterator, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyfold.functions import filters as P
from polyfold.functions import ftsquery as Q
from polyfold.functions import jsonval
from polyfold.functions import text as T

K1, B = 1.2, 0.75


def string_leaves(value: Any, path: str = "") -> Iterator[tuple[str, str]]:
    """(dotted path, text) of every string; list elements share their list's path, a string body has path ''."""
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from string_leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for v in value:
            yield from string_leaves(v, path)


def flatten(d: DataFrame) -> DataFrame:
    """id, field_path, field_content of every string leaf of JSON bodies of any shape; blank leaves are left out."""
    id_type = dict(d.dtypes)["id"]

    def run(batches):
        for b in batches:
            ids, paths, texts = [], [], []
            for i, body in zip(b.column("id").to_pylist(), b.column("body").to_pylist()):
                try:
                    value = json.loads(body) if body is not None else None
                except ValueError:
                    continue
                for path, t in string_leaves(value):
                    if t.strip():
                        ids.append(i)
                        paths.append(path)
                        texts.append(t)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, b.column("id").type), "field_path": pa.array(paths, pa.string()), "field_content": pa.array(texts, pa.string())})

    return d.select("id", "body").mapInArrow(run, f"id {id_type}, field_path string, field_content string")


def flatten_columns(d: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """The same for known string columns, without leaving the JVM."""
    parts = F.array(*[F.struct(F.lit(n).alias("field_path"), c.alias("field_content")) for n, c in fields.items()])
    out = d.select(F.col(id_col).alias("id"), F.explode(parts).alias("x")).select("id", "x.*")
    return out.where(F.length(F.trim(F.col("field_content"))) > 0)


def once(d: DataFrame, keep: list[str], new: dict[str, Column]) -> DataFrame:
    """keep and new columns of d, each computed once a row: the optimizer copies no expression through a generator."""
    return d.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))))


def index_rows(leaves: DataFrame, stem: bool = True) -> DataFrame:
    """id, field_path, tokens, length: the full-text index of flattened documents."""
    t = T.tokens(F.col("field_content"))
    out = once(leaves, ["id", "field_path"], {"tokens": T.stems(t) if stem else t})
    return out.withColumn("length", F.size("tokens"))


def postings(index: DataFrame) -> DataFrame:
    """term, id, field_path, pos: write it sorted by term and lookups read few row groups."""
    return index.select("id", "field_path", F.posexplode("tokens").alias("pos", "term")).select("term", "id", "field_path", "pos")


def _words_of(stem: bool):
    return lambda t: [T.porter(w) if stem else w for w in T.tokens_of(t)]


def _where(term: tuple[str, bool], token: Column) -> Column:
    return token.startswith(term[0]) if term[1] else token == F.lit(term[0])


def _is_at(term: tuple[str, bool]):
    return lambda i: _where(term, F.get(F.col("tokens"), i))


def _occurrences(phrase: Q.Phrase) -> Column:
    """How often a phrase stands in the words in _joined, which have single spaces around them; words are letters and digits only."""
    pattern = " ".join(phrase.words) + ("" if phrase.prefix else " ")
    return F.regexp_count("_joined", F.lit(f"(?<= )(?={pattern})")) if phrase.words else F.lit(0)


def _found(index: DataFrame, node) -> tuple[DataFrame, dict[Q.Phrase, Column]]:
    """index rows with the phrases' positions, or where positions don't matter (no NEAR, no ^) an array of as many elements."""
    phrases = Q.phrases_of(node)
    if not Q.needs_positions(node):
        d = once(index, ["id", "field_path", "length"], {"_joined": F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))})
        d = once(d, ["id", "field_path", "length"], {f"_c{i}": _occurrences(p) for i, p in enumerate(phrases)})
        return d, {p: F.array_repeat(F.lit(0), F.col(f"_c{i}")) for i, p in enumerate(phrases)}
    terms = Q.terms_of(node)
    cols = {t: f"_t{i}" for i, t in enumerate(terms)}
    every = F.sequence(F.lit(0), F.size("tokens") - 1)
    at = {name: F.filter(every, _is_at(t)) for t, name in cols.items()}
    d = once(index, ["id", "field_path", "length"], at)
    return d, {p: Q.positions(p, {t: F.col(n) for t, n in cols.items()}) for p in phrases}


def _found_in_postings(post: DataFrame, lengths: DataFrame, node) -> tuple[DataFrame, dict[Q.Phrase, Column]]:
    """The same from postings: only the query's terms are read, and one shuffle brings a row's words together."""
    terms = Q.terms_of(node)
    cols = {t: f"_t{i}" for i, t in enumerate(terms)}
    some = F.lit(False)
    for t in terms:
        some = some | _where(t, F.col("term"))
    d = post.where(some).groupBy("id", "field_path").agg(*[F.sort_array(F.collect_set(F.when(_where(t, F.col("term")), F.col("pos")))).alias(n) for t, n in cols.items()])
    d = d.join(lengths, ["id", "field_path"])
    return d, {p: Q.positions(p, {t: F.col(n) for t, n in cols.items()}) for p in Q.phrases_of(node)}


def full_text(index: DataFrame, query: str, on: list[str] | None = None, stem: bool = True, post: DataFrame | None = None) -> DataFrame:
    """id, score of the documents that match; score is BM25, negative, lower is better.

    A match lies within one field of one document, and a document has its best field's score. Statistics are
    over all rows of the index; on restricts only what is returned. stem must be as the index was made. With
    post, the inverted index, only the query's words are read.
    """
    node = Q.parse(query, _words_of(stem))
    phrases = Q.phrases_of(node)
    if post is None:
        d, found = _found(index, node)
    else:
        d, found = _found_in_postings(post, index.select("id", "field_path", "length"), node)
    rank_by = Q.hits(node, found)
    new = {"_hit": Q.matches(node, found)} | {f"_f{i}": F.size(rank_by[p]) for i, p in enumerate(phrases)} | {f"_n{i}": (F.size(found[p]) > 0).cast("int") for i, p in enumerate(phrases)}
    d = once(d, ["id", "field_path", "length"], new)
    have = [F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(phrases))]
    # One row of statistics, by a subquery of the same plan. Postings only hold rows with the query's words.
    size = [F.count("*").alias("n"), F.avg("length").alias("avg")]
    if post is None:
        new = {"_s": d.agg(F.struct(*size, *have).alias("s")).scalar()}
    else:
        new = {"_s": index.agg(F.struct(*size).alias("s")).scalar(), "_p": d.agg(F.struct(*have).alias("s")).scalar()}
    d = once(d.where("_hit"), ["id", "field_path", "length", *[f"_f{i}" for i in range(len(phrases))]], new)
    n, avg, rows = F.col("_s.n"), F.col("_s.avg"), [F.col("_s" if post is None else "_p")[f"n{i}"] for i in range(len(phrases))]
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.ln((n - rows[i] + 0.5) / (rows[i] + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        f = F.col(f"_f{i}").cast("double")
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / avg))
    if on:
        d = d.where(F.col("field_path").isin(on))
    return d.withColumn("score", score).groupBy("id").agg(F.min("score").alias("score"))


def trigram_rows(leaves: DataFrame) -> DataFrame:
    """id, trigrams: the distinct trigrams of all of a document's texts."""
    return leaves.select("id", T.trigrams(F.col("field_content")).alias("t")).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("trigrams"))


def fuzzy(trigrams: DataFrame, query: str) -> DataFrame:
    """id, score: how many distinct trigrams of the query a document has (at least one); none below three characters."""
    want = T.trigrams_of(query)
    if not want:
        return trigrams.limit(0).select("id", F.lit(0.0).alias("score"))
    score = F.size(F.array_intersect("trigrams", F.array(*[F.lit(x) for x in want]))).cast("double")
    return trigrams.select("id", score.alias("score")).where("score > 0")


def levenshtein(d: DataFrame, text: Column, query: str, most: int) -> DataFrame:
    """Rows within so many edits of query. An extension; built in."""
    return d.withColumn("distance", F.levenshtein(text, F.lit(query), most)).where("distance >= 0")


def rerank(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """id, score: reciprocal-rank fusion of lists (id, rank). An extension."""
    out = lists[0].select("id", "rank")
    for x in lists[1:]:
        out = out.union(x.select("id", "rank"))
    return out.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("score"))


class DocumentQuery:
    """A search to be built step by step; .frame() gives id, body, score."""

    def __init__(self, documents: DataFrame, index: DataFrame | None = None, trigrams: DataFrame | None = None, stem: bool = True) -> None:
        self._d, self._index, self._trigrams, self._stem = documents, index, trigrams, stem
        self._fts = self._fuzzy = self._on = None
        self._where: list[P.Filter] = []
        self._sort: list[tuple[str, str]] = []
        self._limit = self._offset = None

    def fts(self, query: str, on: list[str] | None = None) -> DocumentQuery:
        self._fts, self._on = query, on
        return self

    def fuzzy(self, query: str) -> DocumentQuery:
        self._fuzzy = query
        return self

    def where(self, *filters: P.Filter) -> DocumentQuery:
        self._where += P.checked_filters(filters)
        return self

    def sort(self, **fields: str) -> DocumentQuery:
        for path, way in fields.items():
            path = P.checked_path(path.replace("__", "."))
            if way not in ("ASC", "DESC"):
                raise ValueError("sort by ASC or DESC")
            self._sort.append((path, way))
        return self

    def limit(self, n: int) -> DocumentQuery:
        self._limit = n
        return self

    def offset(self, n: int) -> DocumentQuery:
        self._offset = n
        return self

    def frame(self) -> DataFrame:
        """Ranked by score when there is text to search (sort is then ignored), else sorted, else by id.

        With fts and fuzzy both must match and the full-text score counts. offset without limit is ignored.
        """
        d = self._d.select("id", "body")
        if self._where or self._sort:
            d = jsonval.parsed(d)
        if self._where:
            d = d.where(P.scan_condition(self._where, F.col("_json")))
        if self._fuzzy is not None:
            hits = fuzzy(self._trigrams if self._trigrams is not None else trigram_rows(flatten(self._d)), self._fuzzy)
            d = d.join(hits if self._fts is None else hits.select("id"), "id")
        if self._fts is not None:
            index = self._index if self._index is not None else index_rows(flatten(self._d), self._stem)
            d = d.join(full_text(index, self._fts, self._on, self._stem), "id")
        if self._fts is not None:
            order = [F.col("score").asc(), F.col("id").asc()]
        elif self._fuzzy is not None:
            order = [F.col("score").desc(), F.col("id").asc()]
        else:
            d = d.withColumn("score", F.lit(None).cast("double"))
            order = [c for path, way in self._sort for c in jsonval.sort_keys(F.col("_json"), path, way == "DESC")] + [F.col("id").asc()]
        d = d.orderBy(*order)
        if self._limit is not None:
            if self._offset:
                d = d.offset(self._offset)
            d = d.limit(self._limit)
        return d.select("id", "body", "score")

    def __iter__(self) -> Iterator[Any]:
        return iter(self.frame().toLocalIterator())

    def __await__(self):
        """All rows; the query runs in a thread of its own."""
        return asyncio.to_thread(self.frame().collect).__await__()

    async def __aiter__(self) -> AsyncIterator[Any]:
        rows = iter(self)
        while (row := await asyncio.to_thread(next, rows, None)) is not None:
            yield row


def search(documents: DataFrame, query: str | None = None, on: list[str] | None = None, fuzzy: bool = False, *, where: list[P.Filter] | None = None, sort: dict[str, str] | None = None, limit: int | None = None, offset: int | None = None, index: DataFrame | None = None, trigrams: DataFrame | None = None, stem: bool = True) -> DataFrame:
    """One call for DocumentQuery; without a query it is a filtered scan."""
    out = DocumentQuery(documents, index, trigrams, stem)
    if query is not None:
        out = out.fuzzy(query) if fuzzy else out.fts(query, on)
    out = out.where(*(where or [])).sort(**(sort or {}))
    if limit is not None:
        out = out.limit(limit)
    return (out.offset(offset) if offset is not None else out).frame()
