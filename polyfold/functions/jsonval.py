"""Typed access to JSON text by VARIANT, with the comparison rules of storage classes.

null is unknown, numbers (booleans count as 1 and 0) come before texts, and arrays and objects compare as
their JSON text. A string is never taken for a number.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(d: DataFrame, body: str = "body", name: str = "_json") -> DataFrame:
    """d with the VARIANT of a JSON text column.

    The one-element array keeps the optimizer from moving the parsing into every use: texts are parsed once.
    """
    return d.select("*", F.inline(F.array(F.struct(F.try_parse_json(F.col(body)).alias(name)))))


def value_at(json: Column, path: str) -> Column:
    """The VARIANT at a dotted path of a VARIANT; NULL if it is absent. Use parsed() to get one from text."""
    return F.try_variant_get(json, "$" + "".join("." + p for p in path.split(".") if p), "variant")


def kind_of(v: Column) -> Column:
    """null, number, bool, text, array or object; NULL if absent."""
    k = F.schema_of_variant(v)
    return (
        F.when(k == "VOID", "null").when(k == "BOOLEAN", "bool").when(k == "STRING", "text")
        .when(k.startswith("ARRAY"), "array").when(k.startswith("OBJECT"), "object").when(k.isNotNull(), "number")
    )


def found(json: Column, path: str) -> Column:
    """Whether the path exists, JSON null included."""
    return F.schema_of_variant(value_at(json, path)).isNotNull()


def number_at(json: Column, path: str) -> Column:
    v = value_at(json, path)
    k = kind_of(v)
    return F.when(k == "bool", F.try_variant_get(v, "$", "boolean").cast("double")).when(k == "number", F.try_variant_get(v, "$", "double"))


def text_at(json: Column, path: str) -> Column:
    v = value_at(json, path)
    k = kind_of(v)
    return F.when(k == "text", F.try_variant_get(v, "$", "string")).when(k.isin("array", "object"), F.to_json(v))


def _apply(op: str, a: Column, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def compare(json: Column, path: str, op: str, value: Any) -> Column:
    """The value at path against a literal; NULL (not true) for absent, JSON null and a None literal."""
    num, text = number_at(json, path), text_at(json, path)
    if op == "is_null":
        return num.isNull() & text.isNull()
    if value is None:
        return F.lit(None).cast("boolean")
    if isinstance(value, str):
        return F.when(text.isNotNull(), _apply(op, text, F.lit(value))).when(num.isNotNull(), F.lit(op in ("<", "<=", "!=")))
    return F.when(num.isNotNull(), _apply(op, num, F.lit(float(value)))).when(text.isNotNull(), F.lit(op in (">", ">=", "!=")))


def sort_keys(json: Column, path: str, descending: bool = False) -> list[Column]:
    """Columns to order by: null, then numbers, then texts; reversed as a whole when descending."""
    num, text = number_at(json, path), text_at(json, path)
    rank = F.when(num.isNotNull(), 1).when(text.isNotNull(), 2).otherwise(0)
    return [c.desc() if descending else c.asc() for c in (rank, num, text)]


def normalized(json: Column, path: str) -> tuple[Column, Column]:
    """Text and number form of a scalar, as a field index holds them; arrays and objects have neither."""
    v = value_at(json, path)
    k = kind_of(v)
    num = number_at(json, path)
    text = F.when(k == "bool", F.when(num == 1, "true").otherwise("false")).when(k.isin("number", "text"), F.try_variant_get(v, "$", "string"))
    return text, num


def dumps(value: Any) -> str:
    """The JSON text a value is stored as; models write themselves."""
    import json

    if hasattr(value, "model_dump_json"):
        return value.model_dump_json()
    return json.dumps(value)


def loads(text: str, model: type | None = None) -> Any:
    import json

    return model.model_validate_json(text) if model is not None and hasattr(model, "model_validate_json") else json.loads(text)
