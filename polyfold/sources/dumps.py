"""JSON and JSON-lines export and import of collections.

json is one object {metadata: {type, name, count, ...}, items: [...]}; jsonl has one item a line. Frames are written
by Spark in parallel; a file object gets the items as they stream in, never the whole collection at once.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Iterator
from typing import IO, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Items of each kind as columns of its rows; value columns hold JSON text.
SHAPES = {
    "dict": ["key", "value"],
    "list": ["value"],
    "queue": ["priority", "timestamp", "data"],
    "log": ["timestamp", "data"],
    "docs": ["id", "body"],
    "blob": ["key", "metadata", "size", "payload"],
}
_JSON = {"value", "data", "body", "metadata"}


def item_json(kind: str) -> Column:
    """The JSON text of a row's item."""
    if kind == "list":
        return F.col("value")
    parts = []
    for c in SHAPES[kind]:
        text = F.coalesce(F.col(c), F.lit("null")) if c in _JSON else F.to_json(F.array(F.col(c)))
        parts.append(F.concat(F.lit(json.dumps(c) + ":"), text if c in _JSON else F.substring(text, 2, F.length(text) - 2)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def blob_rows(d: DataFrame) -> DataFrame:
    """key, metadata, size, payload (base64) of blobs."""
    return d.select("key", "metadata", F.octet_length("data").alias("size"), F.regexp_replace(F.base64("data"), r"\s", "").alias("payload"))


def write_lines(d: DataFrame, kind: str, path: str) -> None:
    """All items as JSON lines in a folder, each partition its own file."""
    d.select(item_json(kind)).write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """item: the JSON text of each line."""
    return spark.read.text(path).select(F.col("value").alias("item")).where("item <> ''")


def header(kind: str, name: str, count: int, **more: Any) -> dict[str, Any]:
    return {"type": kind, "name": name, "count": count, "dump_date": datetime.datetime.now(datetime.UTC).isoformat(), **more}


def dump(items: Iterable[str], metadata: dict[str, Any], fp: IO[str] | None, format: str = "json") -> dict[str, Any] | None:
    """Writes item texts to fp, or returns the whole object if fp is None (json only)."""
    if format not in ("json", "jsonl"):
        raise ValueError(f"unknown format {format!r}")
    if format == "jsonl":
        if fp is None:
            raise ValueError("jsonl needs a file")
        for x in items:
            fp.write(x + "\n")
        return None
    if fp is None:
        return {"metadata": metadata, "items": [json.loads(x) for x in items]}
    fp.write('{"metadata": ' + json.dumps(metadata) + ', "items": [')
    for i, x in enumerate(items):
        fp.write((", " if i else "") + x)
    fp.write("]}")
    return None


def load(fp: IO[str], format: str = "json") -> Iterator[Any]:
    if format == "json":
        yield from json.load(fp)["items"]
    elif format == "jsonl":
        for line in fp:
            if line.strip():
                yield json.loads(line)
    else:
        raise ValueError(f"unknown format {format!r}")


def check_strategy(strategy: str) -> str:
    if strategy not in ("overwrite", "append"):
        raise ValueError("strategy must be overwrite or append")
    return strategy
