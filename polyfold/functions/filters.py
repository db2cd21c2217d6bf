"""Predicates: q("a.b") >= 5 builds a Filter; filters are ANDed."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from polyfold.functions import jsonval

PATH = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*")


def checked_path(path: str) -> str:
    """path, if it is dotted names; ValueError else, as paths end up in expressions."""
    if not PATH.fullmatch(path):
        raise ValueError(f"not a field path: {path!r}")
    return path


@dataclass(frozen=True)
class Filter:
    path: str
    op: str
    value: Any


class Query:
    """A field path; comparing it gives a Filter, reading an attribute goes one level down."""

    __hash__ = None

    def __init__(self, path: str = "") -> None:
        object.__setattr__(self, "_path", path)

    def __getattr__(self, name: str) -> Query:
        if name.startswith("__"):
            raise AttributeError(name)
        return Query(f"{self._path}.{name}" if self._path else name)

    __getitem__ = __getattr__

    def _compare(self, op: str, value: Any) -> Filter:
        return Filter(checked_path(self._path), op, value)

    def __eq__(self, other: Any) -> Filter:  # type: ignore[override]
        return self._compare("==", other)

    def __ne__(self, other: Any) -> Filter:  # type: ignore[override]
        return self._compare("!=", other)

    def __gt__(self, other: Any) -> Filter:
        return self._compare(">", other)

    def __ge__(self, other: Any) -> Filter:
        return self._compare(">=", other)

    def __lt__(self, other: Any) -> Filter:
        return self._compare("<", other)

    def __le__(self, other: Any) -> Filter:
        return self._compare("<=", other)

    def is_null(self) -> Filter:
        """Absent or JSON null; comparisons with None are never true."""
        return self._compare("is_null", None)


def q(start: str | type | None = None) -> Query:
    """A path builder; a model class only serves readers, its fields are reached as attributes."""
    return Query(start if isinstance(start, str) else "")


def checked_filters(filters: tuple) -> list[Filter]:
    for f in filters:
        if not isinstance(f, Filter):
            raise TypeError(f"expected a Filter, got {type(f).__name__}")
    return list(filters)


def scan_condition(filters: list[Filter], json: Column) -> Column:
    """All filters on a VARIANT. Nothing is pushed into the scan: see fieldindex for typed columns."""
    out = F.lit(True)
    for f in filters:
        out = out & jsonval.compare(json, f.path, f.op, f.value)
    return out


def typed_condition(filters: list[Filter], columns: dict[str, Column]) -> Column:
    """All filters on typed columns, as plain comparisons that Catalyst pushes into the scan."""
    out = F.lit(True)
    for f in filters:
        c, v = columns[f.path], F.lit(f.value)
        out = out & {"==": c == v, "!=": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v, "is_null": c.isNull()}[f.op]
    return out
