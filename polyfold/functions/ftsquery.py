"""The full-text query language: parsed into a tree, evaluated as Columns over positions of words.

    a b            both (binds tightest, between phrases only)      a OR b, a AND b, a NOT b, ( )
    "a b", a + b   phrase          pre*   prefix          ^a   first word of the field
    NEAR(a b, 5)   within five words          field_content : a   the same as a

NOT binds tighter than AND, AND tighter than OR. Malformed input raises ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The only column that can be named.
COLUMN = "field_content"
_LEX = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<word>[A-Za-z0-9_\x1a\u0080-\U0010ffff]+)|(?P<sign>[()+*^:,{}-]))')


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    initial: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int


@dataclass(frozen=True)
class Node:
    op: str
    parts: tuple = field(default=())


class _Parser:
    def __init__(self, text: str, words_of: Callable[[str], list[str]]) -> None:
        self.words_of, self.items, self.i = words_of, [], 0
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise ValueError(f"syntax error near {text[at:at + 10]!r}")
            kind = m.lastgroup
            self.items.append((kind, m[kind]))
            at = m.end()

    def peek(self, ahead: int = 0) -> tuple[str | None, str]:
        return self.items[self.i + ahead] if self.i + ahead < len(self.items) else (None, "")

    def take(self, sign: str | None = None) -> tuple[str | None, str]:
        x = self.peek()
        if x[0] is None or (sign and x != ("sign", sign)):
            raise ValueError(f"expected {sign or 'more'}, got {x[1]!r}")
        self.i += 1
        return x

    def is_word(self, *words: str) -> bool:
        return self.peek()[0] == "word" and self.peek()[1] in words

    def chain(self, word: str, below: Callable[[], object]):
        parts = [below()]
        while self.is_word(word):
            self.take()
            parts.append(below())
        if len(parts) == 1:
            return parts[0]
        if word != "NOT":
            return Node(word, tuple(parts))
        out = parts[0]
        for p in parts[1:]:
            out = Node("NOT", (out, p))
        return out

    def expression(self):
        return self.chain("OR", lambda: self.chain("AND", lambda: self.chain("NOT", self.group)))

    def group(self):
        if self.peek() == ("sign", "("):
            self.take()
            out = self.expression()
            self.take(")")
            return out
        parts = [self.near()]
        while self.peek()[0] in ("string", "word") and not self.is_word("AND", "OR", "NOT") or self.peek() == ("sign", "^"):
            parts.append(self.near())
        return parts[0] if len(parts) == 1 else Node("AND", tuple(parts))

    def near(self):
        if self.peek()[0] == "word" and self.peek(1) == ("sign", ":"):
            name = self.take()[1]
            self.take()
            if name != COLUMN:
                raise ValueError(f"no such column: {name}")
            if self.peek() == ("sign", "("):
                return self.group()
        if self.is_word("NEAR") and self.peek(1) == ("sign", "("):
            self.take()
            self.take()
            phrases, distance = [self.phrase()], 10
            while self.peek() not in (("sign", ")"), ("sign", ",")):
                phrases.append(self.phrase())
            if self.peek() == ("sign", ","):
                self.take()
                n = self.take()[1]
                if not n.isdigit():
                    raise ValueError(f"expected a number, got {n!r}")
                distance = int(n)
            self.take(")")
            return Near(tuple(phrases), distance)
        return self.phrase()

    def phrase(self) -> Phrase:
        initial = self.peek() == ("sign", "^")
        if initial:
            self.take()
        words: list[str] = []
        while True:
            kind, text = self.take()
            if kind not in ("string", "word") or (kind == "word" and text in ("AND", "OR", "NOT")):
                raise ValueError(f"syntax error near {text!r}")
            words += self.words_of(text[1:-1].replace('""', '"') if kind == "string" else text)
            if self.peek() != ("sign", "+"):
                break
            self.take()
        prefix = self.peek() == ("sign", "*")
        if prefix:
            self.take()
        return Phrase(tuple(words), prefix, initial)


def parse(text: str, words_of: Callable[[str], list[str]]):
    p = _Parser(text, words_of)
    if not p.items:
        raise ValueError("empty query")
    out = p.expression()
    if p.i != len(p.items):
        raise ValueError(f"syntax error near {p.peek()[1]!r}")
    return out


def phrases_of(node) -> list[Phrase]:
    """The phrases of a query, each once, in order."""
    if isinstance(node, Phrase):
        return [node]
    parts = node.phrases if isinstance(node, Near) else node.parts
    return list(dict.fromkeys(p for x in parts for p in phrases_of(x)))


def needs_positions(node) -> bool:
    """Whether it matters where phrases stand, not only how often."""
    if isinstance(node, Phrase):
        return node.initial
    return isinstance(node, Near) or any(map(needs_positions, node.parts))


def terms_of(node) -> list[tuple[str, bool]]:
    """(word, whether it is a prefix) that a query looks up."""
    return list(dict.fromkeys((w, p.prefix and i == len(p.words) - 1) for p in phrases_of(node) for i, w in enumerate(p.words)))


def _moved(by: int):
    return lambda p: p - F.lit(by)


def positions(phrase: Phrase, at: dict[tuple[str, bool], Column]) -> Column:
    """Start positions of a phrase, given the positions of its words."""
    if not phrase.words:
        return F.array().cast("array<int>")
    last = len(phrase.words) - 1
    out = at[phrase.words[0], phrase.prefix and last == 0]
    for i in range(1, last + 1):
        # Where word i stands, moved back by i; an intersection of sets takes time in proportion.
        out = F.array_intersect(out, F.transform(at[phrase.words[i], phrase.prefix and i == last], _moved(i)))
    return F.filter(out, lambda p: p == 0) if phrase.initial else out


def near_positions(near: Near, found: dict[Phrase, Column]) -> list[Column]:
    """For each phrase its positions that lie in a match: every phrase begins at or before a place where one of them
    begins, and ends at most distance words before it."""
    if len(near.phrases) == 1:
        return [found[near.phrases[0]]]
    reach = [len(p.words) + near.distance for p in near.phrases]

    def within(n: int, place: Column):
        return lambda p: (p <= place) & (p >= place - F.lit(n))

    def complete(place: Column) -> Column:
        out = F.lit(True)
        for p, n in zip(near.phrases, reach):
            out = out & F.exists(found[p], within(n, place))
        return out

    places = found[near.phrases[0]]
    for p in near.phrases[1:]:
        places = F.array_union(places, found[p])
    places = F.filter(places, complete)

    def inside(n: int):
        return lambda p: F.exists(places, lambda place: (p <= place) & (p >= place - F.lit(n)))

    return [F.filter(found[p], inside(n)) for p, n in zip(near.phrases, reach)]


def matches(node, found: dict[Phrase, Column]) -> Column:
    """Whether a row matches."""
    if isinstance(node, Phrase):
        return F.size(found[node]) > 0
    if isinstance(node, Near):
        return F.size(near_positions(node, found)[0]) > 0
    parts = [matches(p, found) for p in node.parts]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if node.op == "AND" else out | p if node.op == "OR" else out & ~p
    return out


def hits(node, found: dict[Phrase, Column]) -> dict[Phrase, Column]:
    """The positions of each phrase that count for ranking: within NEAR only those of a match."""
    if isinstance(node, Phrase):
        return {node: found[node]}
    if isinstance(node, Near):
        return dict(zip(node.phrases, near_positions(node, found)))
    out: dict[Phrase, Column] = {}
    for p in node.parts:
        out = hits(p, found) | out
    return out
