"""HyperLogLog and Bloom filter as Catalyst expressions: hashing, registers and bits all stay in the JVM."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hll_precision(error: float) -> int:
    """Bits of the register index."""
    return max(4, min(18, math.ceil(2 * math.log2(1.04 / error))))


def bloom_size(capacity: int, error: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter."""
    bits = -capacity * math.log(error) / math.log(2) ** 2
    return math.ceil(bits), math.ceil(bits / capacity * math.log(2))


def _little_endian(hex_text: Column, at: int) -> Column:
    """The eight bytes from hex digit at (from 1) on, lowest byte first, as 16 hex digits."""
    return F.concat(*[F.substring(hex_text, at + 2 * i, 2) for i in range(7, -1, -1)])


def item_text(item: Column, dtype: str = "string") -> Column:
    """What is hashed: the item's JSON text."""
    if dtype == "string":
        return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(item, r"\\", r"\\\\"), '"', '\\\\"'), F.lit('"'))
    return item.cast("string")


def _once(d: DataFrame, keep: list[str], **new: Column) -> DataFrame:
    """New columns, each computed once a row: the optimizer copies no expression through a generator."""
    return d.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))))


def hll_registers(df: DataFrame, text: Column, error: float = 0.01) -> DataFrame:
    """register, rank: the mergeable sketch of SHA-1's first eight bytes, low bits and trailing zeros of the rest.

    Partial maxima are taken before the shuffle, which moves 2**p rows a task.
    """
    p = hll_precision(error)
    d = _once(df.where(text.isNotNull()), [], s=F.sha1(text))
    d = _once(d, [], h=F.conv(_little_endian(F.col("s"), 1), 16, -10).cast("bigint"))
    d = _once(d, ["h"], w=F.shiftrightunsigned("h", p))
    w = F.col("w")
    zeros = F.when(w == 0, 64).otherwise(F.bit_count(w.bitwiseAND(-w) - 1))
    d = d.select(F.col("h").bitwiseAND(F.lit((1 << p) - 1)).cast("int").alias("register"), (F.least(zeros, F.lit(64 - p)) + 1).cast("int").alias("rank"))
    return d.groupBy("register").agg(F.max("rank").alias("rank"))


def hll_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("register").agg(F.max("rank").alias("rank"))


def hll_alpha(m: int) -> float:
    # The bias corrections of HyperLogLog (Flajolet et al. 2007).
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def hll_count(registers: DataFrame, error: float = 0.01) -> DataFrame:
    """One row, n: the estimated number of distinct items."""
    m = 1 << hll_precision(error)
    alpha = hll_alpha(m)
    s = registers.agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("s"), F.count("*").alias("k"))
    zeros = m - F.col("k")
    raw = F.lit(alpha * m * m) / (F.col("s") + zeros)
    return s.select(F.when((raw <= 2.5 * m) & (zeros > 0), F.lit(float(m)) * F.ln(F.lit(float(m)) / zeros)).otherwise(raw).cast("bigint").alias("n"))


def _residue(hex16: Column, m: int) -> Column:
    """An unsigned 64-bit number modulo m, in two halves, so that plain 64-bit arithmetic never overflows."""
    high, low = (F.conv(F.substring(hex16, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    return ((high % m) * ((1 << 32) % m) + low) % m


def bloom_positions(df: DataFrame, keep: list[str], text: Column, bits: int, hashes: int) -> DataFrame:
    """keep and pos: each item's bit positions (h1 + i * h2) mod bits, from MD5's two halves; fewer than 2**31 bits."""
    d = _once(df.where(text.isNotNull()), keep, _h=F.md5(text))
    d = _once(d, keep, _a=_residue(_little_endian(F.col("_h"), 1), bits), _b=_residue(_little_endian(F.col("_h"), 17), bits))
    return d.select(*keep, F.explode(F.array(*[(F.col("_a") + i * F.col("_b")) % bits for i in range(hashes)])).alias("pos"))


def bloom_bits(df: DataFrame, text: Column, capacity: int, error: float) -> DataFrame:
    """pos: the distinct bits that are set."""
    return bloom_positions(df, [], text, *bloom_size(capacity, error)).distinct()


def bloom_contains(probe: DataFrame, id_col: str, text: Column, bits_df: DataFrame, capacity: int, error: float) -> DataFrame:
    """id, maybe: whether all of an item's bits are set."""
    want = bloom_positions(probe, [id_col], text, *bloom_size(capacity, error)).distinct()
    hit = want.join(bits_df.withColumn("set", F.lit(1)), "pos", "left")
    return hit.groupBy(id_col).agg((F.count("*") == F.count("set")).alias("maybe"))


class SketchState:
    """Both sketches in memory, for single items: what a store keeps as one binary value."""

    def __init__(self, capacity: int, error: float, packed: bytes | None = None) -> None:
        self.p = hll_precision(error)
        self.bits, self.hashes = bloom_size(capacity, error)
        raw = np.frombuffer(zlib.decompress(packed), np.uint8) if packed else np.zeros((1 << self.p) + -(-self.bits // 8), np.uint8)
        self.registers, self.bloom = raw[: 1 << self.p].copy(), raw[1 << self.p :].copy()

    def pack(self) -> bytes:
        return zlib.compress(self.registers.tobytes() + self.bloom.tobytes(), 1)

    def _positions(self, text: str) -> list[int]:
        h = hashlib.md5(text.encode()).digest()
        a, b = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little")
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def add(self, texts: Iterable[str]) -> None:
        for text in texts:
            h = int.from_bytes(hashlib.sha1(text.encode()).digest()[:8], "little")
            w = h >> self.p
            rank = min((w & -w).bit_length() - 1 if w else 64, 64 - self.p) + 1
            at = h & ((1 << self.p) - 1)
            self.registers[at] = max(int(self.registers[at]), rank)
            for x in self._positions(text):
                self.bloom[x >> 3] |= 1 << (x & 7)

    def merge(self, registers: DataFrame, bits: DataFrame) -> None:
        """Takes in hll_registers and bloom_bits, which are bounded by the sketch's own size."""
        r, b = registers.toArrow(), bits.toArrow()["pos"].to_numpy()
        np.maximum.at(self.registers, r["register"].to_numpy(), r["rank"].to_numpy().astype(np.uint8))
        np.bitwise_or.at(self.bloom, b >> 3, (1 << (b & 7)).astype(np.uint8))

    def contains(self, text: str) -> bool:
        return all(self.bloom[x >> 3] >> (x & 7) & 1 for x in self._positions(text))

    def count(self) -> int:
        m = 1 << self.p
        raw = hll_alpha(m) * m * m / float(np.exp2(-self.registers.astype(float)).sum())
        zeros = int((self.registers == 0).sum())
        return int(m * math.log(m / zeros)) if raw <= 2.5 * m and zeros else int(raw)
