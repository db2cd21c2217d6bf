"""A command line over a store: python -m polyfold --store PATH dict users set ada '{"age": 36}'

Values are JSON, in and out; what is no JSON is taken as text. Exit status 1 where a key, an index or an item is missing.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from typing import IO, Any

from pyspark.sql import SparkSession

from polyfold.functions import filters as P
from polyfold.sources.store import Store


def value(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return text


def condition(text: str) -> P.Filter:
    """field=value, or with != > >= < <=."""
    for op in ("!=", ">=", "<=", "=", ">", "<"):
        if op in text:
            path, _, right = text.partition(op)
            return P.Filter(P.checked_path(path.strip()), "==" if op == "=" else op, value(right.strip()))
    raise argparse.ArgumentTypeError(f"no comparison in {text!r}")


#: By group and command: the arguments with their types (a ? marks options) and what is done with them.
COMMANDS: dict[str, dict[str, tuple[dict[str, Any], Callable[..., Any]]]] = {
    "dict": {
        "get": ({"key": str}, lambda m, key: m.get(key)),
        "set": ({"key": str, "value": value, "ttl?": float}, lambda m, key, value, ttl: m.set(key, value, ttl)),
        "del": ({"key": str}, lambda m, key: m.delete(key)),
        "keys": ({}, lambda m: list(m.keys())),
        "items": ({}, lambda m: dict(m.items())),
    },
    "list": {
        "get": ({"index": int}, lambda m, index: m.get(index)),
        "push": ({"value": value}, lambda m, value: m.push(value)),
        "prepend": ({"value": value}, lambda m, value: m.prepend(value)),
        "insert": ({"index": int, "value": value}, lambda m, index, value: m.insert(index, value)),
        "set": ({"index": int, "value": value}, lambda m, index, value: m.set(index, value)),
        "del": ({"index": int}, lambda m, index: m.delete(index)),
        "pop": ({}, lambda m: m.pop()),
        "deque": ({}, lambda m: m.deque()),
        "items": ({"start?": int, "stop?": int}, lambda m, start, stop: m.get(slice(start, stop))),
    },
    "queue": {
        "put": ({"value": value, "priority": float}, lambda m, value, priority: m.put(value, priority)),
        "get": ({"timeout?": float}, lambda m, timeout: m.get(block=timeout is not None, timeout=timeout)),
        "peek": ({}, lambda m: m.peek()),
        "items": ({}, lambda m: list(m)),
    },
    "log": {
        "log": ({"value": value, "timestamp?": float}, lambda m, value, timestamp: m.log(value, timestamp)),
        "range": ({"start?": float, "end?": float, "limit?": int, "offset?": int, "order?": str, "where*": condition}, lambda m, start, end, limit, offset, order, where: m.range(start, end, limit, where, order or "ASC", offset)),
        "reindex": ({"field*": str}, lambda m, field: m.reindex(field)),
    },
}
#: What every collection has.
COMMON: dict[str, tuple[dict[str, Any], Callable[..., Any]]] = {
    "count": ({}, lambda m: m.count()),
    "clear": ({}, lambda m: m.clear()),
    "dump": ({}, lambda m: m.dump()),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="polyfold", description="Named collections of a store.")
    out.add_argument("--store", required=True, help="path of the store")
    groups = out.add_subparsers(dest="group", required=True)
    groups.add_parser("report", help="rows of every collection")
    for group, own in COMMANDS.items():
        g = groups.add_parser(group)
        g.add_argument("name")
        commands = g.add_subparsers(dest="command", required=True)
        for command, (arguments, _) in {**own, **COMMON}.items():
            c = commands.add_parser(command)
            for a, kind in arguments.items():
                if a.endswith("?"):
                    c.add_argument("--" + a[:-1], type=kind)
                elif a.endswith("*"):
                    c.add_argument("--" + a[:-1], type=kind, action="append")
                else:
                    c.add_argument(a, type=kind)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out: IO[str] | None = None) -> int:
    """Runs one command; prints its result as JSON, and nothing for changes."""
    a = vars(parser().parse_args(argv))
    if spark is None:
        from polyfold.session import build_session

        spark = build_session()
    store = Store(spark, a["store"])
    if a["group"] == "report":
        result: Any = [r.asDict() for r in store.report().collect()]
    else:
        arguments, run = {**COMMANDS[a["group"]], **COMMON}[a["command"]]
        try:
            result = run(getattr(store, a["group"])(a["name"]), **{x.rstrip("?*"): a[x.rstrip("?*")] for x in arguments})
        except (KeyError, IndexError, TimeoutError) as e:
            print(f"{type(e).__name__}: {e}", file=sys.stderr)
            return 1
    if result is not None:
        print(json.dumps(result, ensure_ascii=False), file=out or sys.stdout)
    return 0
