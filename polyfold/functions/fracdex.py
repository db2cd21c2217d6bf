"""Fractional index: base-62 keys between any two keys, in byte order."""

from __future__ import annotations

# The digits of keys, in byte order.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def key_between(a: str | None, b: str | None) -> str:
    """A key strictly between a and b; None is no bound. Keys never end in the lowest digit, so there is always room."""
    if a is not None and b is not None and a >= b:
        raise ValueError(f"no key between {a!r} and {b!r}")
    low, out, i = a or "", "", 0
    bounded = b is not None
    while True:
        if bounded and i >= len(b):  # only keys of foreign make, ending in the lowest digit, leave no room
            raise ValueError(f"no key between {a!r} and {b!r}")
        x = DIGITS.index(low[i]) if i < len(low) else 0
        y = (DIGITS.index(b[i]) if i < len(b) else 0) if bounded else len(DIGITS)
        if y - x > 1:
            return out + DIGITS[(x + y) // 2]
        out += DIGITS[x]
        if x != y:
            bounded = False
        i += 1


def keys_after(last: str | None, n: int) -> list[str]:
    """n keys in ascending order, all after last."""
    out: list[str] = []
    for _ in range(n):
        last = key_between(last, None)
        out.append(last)
    return out


def keys_before(first: str | None, n: int) -> list[str]:
    """n keys in descending order, all before first."""
    out: list[str] = []
    for _ in range(n):
        first = key_between(None, first)
        out.append(first)
    return out
