"""Declared fields of JSON rows, as typed columns or as entity-attribute-value rows, and what a plan can use of them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyfold.functions import filters as P
from polyfold.functions import jsonval


class UnindexableFieldError(ValueError):
    """A declared field held an array or an object."""


@dataclass
class Manifest:
    """Declared fields; complete says whether all rows are indexed."""

    fields: dict[str, bool] = field(default_factory=dict)

    def declare(self, *names: str, complete: bool = False) -> Manifest:
        """Adds fields; declaring again never takes completeness away."""
        for n in names:
            self.fields[P.checked_path(n)] = self.fields.get(n, False) or complete
        return self

    def mark_complete(self, *names: str) -> Manifest:
        for n in names:
            self.fields[n] = True
        return self

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(sorted(self.fields.items()), "field string, complete boolean")


def text_column(path: str) -> str:
    return "ix_" + path.replace(".", "__") + "_text"


def number_column(path: str) -> str:
    return "ix_" + path.replace(".", "__") + "_num"


def materialise(d: DataFrame, paths: list[str], body: str = "data") -> DataFrame:
    """d with a text and a number column for each declared field, so that filters on them reach the scan."""
    if not paths:
        return d
    v = F.col("_json")
    return jsonval.parsed(d, body).select(*d.columns, *[c for p in paths for c in (jsonval.text_at(v, p).alias(text_column(p)), jsonval.number_at(v, p).alias(number_column(p)))])


def _typed(f: P.Filter) -> Column:
    """The comparison of jsonval.compare, on the typed columns. Literals of one class need one column for == only."""
    num, text, v = F.col(number_column(f.path)), F.col(text_column(f.path)), f.value
    if f.op == "is_null":
        return num.isNull() & text.isNull()
    if v is None:
        return F.lit(None).cast("boolean")
    own, other, lit = (text, num, F.lit(v)) if isinstance(v, str) else (num, text, F.lit(float(v)))
    same = {"==": own == lit, "!=": own != lit, ">": own > lit, ">=": own >= lit, "<": own < lit, "<=": own <= lit}[f.op]
    also = f.op in (("<", "<=", "!=") if isinstance(v, str) else (">", ">=", "!="))
    return (same | other.isNotNull()) if also else same


def plan(filters: list[P.Filter], manifest: Manifest | None) -> tuple[list[P.Filter], list[P.Filter]]:
    """Filters that typed columns can answer, and filters that must read the JSON text."""
    done = manifest.fields if manifest else {}
    indexed = [f for f in filters if done.get(f.path)]
    return indexed, [f for f in filters if f not in indexed]


def where(d: DataFrame, filters: list[P.Filter], manifest: Manifest | None, body: str = "data") -> DataFrame:
    """Rows that pass all filters: those on typed columns first, so that only rows they keep are parsed."""
    indexed, scanned = plan(filters, manifest)
    for f in indexed:
        d = d.where(_typed(f))
    if scanned:
        d = jsonval.parsed(d, body).where(P.scan_condition(scanned, F.col("_json"))).drop("_json")
    return d


def explain(d: DataFrame, filters: list[P.Filter], manifest: Manifest | None) -> dict[str, Any]:
    """indexed and scanned fields and estimated_rows (all rows)."""
    indexed, scanned = plan(filters, manifest)
    return {"indexed": [f.path for f in indexed], "scanned": [f.path for f in scanned], "estimated_rows": d.count()}


def rows(d: DataFrame, key: str, body: str, paths: list[str]) -> DataFrame:
    """item_key, field, value, value_num: one row for each declared field that is present (JSON null included)."""
    parts = []
    v = F.col("_json")
    for p in paths:
        text, num = jsonval.normalized(v, P.checked_path(p))
        parts.append(F.struct(F.lit(p).alias("field"), jsonval.found(v, p).alias("found"), text.alias("value"), num.alias("value_num"), jsonval.kind_of(jsonval.value_at(v, p)).alias("kind")))
    out = jsonval.parsed(d, body).select(F.col(key).alias("item_key"), F.explode(F.array(*parts)).alias("x")).where("x.found")
    bad = F.raise_error(F.concat(F.lit("field is an array or object: "), F.col("x.field")))
    kind = F.when(F.col("x.kind").isin("array", "object"), bad.cast("string")).otherwise(F.col("x.value"))
    return out.select("item_key", "x.field", kind.alias("value"), "x.value_num")


def replace_rows(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with new rows in place of those of the same items."""
    return index.join(new.select("item_key").distinct(), "item_key", "left_anti").unionByName(new)


def stats(index: DataFrame, manifest: Manifest | None = None) -> DataFrame:
    """field, complete, n: rows of each declared field."""
    n = index.groupBy("field").agg(F.count("*").alias("n"))
    if manifest is None:
        return n
    return manifest.frame(index.sparkSession).join(n, "field", "left").select("field", "complete", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def lookup(index: DataFrame, f: P.Filter) -> DataFrame:
    """item_key of the items that pass one filter, from the index alone; ranges compare numbers."""
    own = index.where(F.col("field") == f.path)
    if isinstance(f.value, str) and f.op in ("==", "!="):
        c = F.col("value") == f.value if f.op == "==" else F.col("value") != f.value
    elif isinstance(f.value, str) or f.value is None:
        raise ValueError("an index range needs a number")
    else:
        c = P.typed_condition([f], {f.path: F.col("value_num")})
    return own.where(c).select("item_key").distinct()


def semi_join(d: DataFrame, key: str, index: DataFrame, filters: list[P.Filter]) -> DataFrame:
    """Rows of d whose items pass all filters by the index."""
    for f in filters:
        d = d.join(lookup(index, f).withColumnRenamed("item_key", key), key, "left_semi")
    return d
