"""Key-value maps with expiry. Rows: key, value, expires_at (epoch seconds, null for never)."""

from __future__ import annotations

import hashlib
import time
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_ttl(ttl: Any) -> float | None:
    """ValueError unless ttl is None or a positive number."""
    if ttl is not None and (isinstance(ttl, bool) or not isinstance(ttl, (int, float)) or ttl <= 0):
        raise ValueError("ttl_seconds must be a positive number")
    return None if ttl is None else float(ttl)


def latest(ops: DataFrame, key: str | list[str] = "key", seq: str = "seq") -> DataFrame:
    """The last row of each key, if it is a put: the snapshot of an operation log (columns op and seq).

    Partial maxima are taken before the shuffle, so a key that is written often costs one row a task.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in ops.columns if c not in keys]
    last = ops.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).where(F.col("op") == "put")


def set_rows(keys_values: DataFrame, now: float, ttl: float | None = None) -> DataFrame:
    """Rows for an upsert of (key, value)."""
    ttl = check_ttl(ttl)
    return keys_values.select("key", "value", F.lit(None if ttl is None else now + ttl).cast("double").alias("expires_at"))


def is_live(now: float | Column) -> Column:
    """A row counts up to and including its expiry."""
    return F.col("expires_at").isNull() | (F.lit(now) <= F.col("expires_at"))


def live(d: DataFrame, now: float | None = None) -> DataFrame:
    return d.where(is_live(time.time() if now is None else now))


def get(d: DataFrame, key: Any, now: float) -> DataFrame:
    """The live row of key; none if it is missing or expired."""
    return live(d.where(F.col("key") == F.lit(key)), now)


def fetch(d: DataFrame, keys: DataFrame, now: float, default: Any = None) -> DataFrame:
    """key, value for each key of keys; default where there is no live row."""
    found = live(d, now).select("key", F.col("value").alias("_v"))
    out = keys.select("key").join(found, "key", "left")
    return out.select("key", F.coalesce("_v", F.lit(default)).alias("value") if default is not None else F.col("_v").alias("value"))


def contains(d: DataFrame, keys: DataFrame) -> DataFrame:
    """key, present for each key; expired rows are present."""
    mine = d.select("key", F.lit(True).alias("_p"))
    return keys.select("key").join(mine, "key", "left").select("key", F.coalesce("_p", F.lit(False)).alias("present"))


def count(d: DataFrame) -> DataFrame:
    """n, expired rows included."""
    return d.agg(F.count("*").alias("n"))


def keys(d: DataFrame) -> DataFrame:
    return d.select("key").orderBy("key")


def items(d: DataFrame) -> DataFrame:
    return d.select("key", "value").orderBy("key")


def delete(d: DataFrame, gone: DataFrame) -> DataFrame:
    """d without the keys of gone."""
    return d.join(gone.select("key").distinct(), "key", "left_anti")


def pop(d: DataFrame, key: Any, now: float) -> tuple[DataFrame, DataFrame]:
    """The live row of key, and d without the key (an expired row goes too)."""
    return get(d, key, now), d.where(F.col("key") != F.lit(key))


def upsert(d: DataFrame, new: DataFrame) -> DataFrame:
    """d with the rows of new in place of its own of the same key; the last of new by its column seq, if it has one."""
    if "seq" in new.columns:
        w = Window.partitionBy("key").orderBy(F.col("seq").desc())
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "seq")
    return d.join(new.select("key").distinct(), "key", "left_anti").unionByName(new.select(*d.columns))


def derive_key(secret: str, salt: bytes) -> bytes:
    """The 32-byte key of a secret (PBKDF2-SHA256, 100000 rounds)."""
    return hashlib.pbkdf2_hmac("sha256", secret.encode(), salt, 100_000, 32)


def encrypt(value: Column, key: bytes) -> Column:
    """AES-GCM, base64."""
    return F.base64(F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM")))


def decrypt(value: Column, key: bytes) -> Column:
    """NULL where the key doesn't fit."""
    return F.try_aes_decrypt(F.unbase64(value), F.lit(key), F.lit("GCM")).cast("string")


class Secret:
    """A one-way hash that compares equal to the value it was made of."""

    __hash__ = None

    def __init__(self, value: str | None = None, *, salt: bytes | None = None, digest: bytes | None = None) -> None:
        import os

        self.salt = salt or os.urandom(16)
        self.digest = digest if digest is not None else derive_key(value or "", self.salt)

    def __eq__(self, other: object) -> bool:
        if isinstance(other, Secret):
            return self.salt == other.salt and self.digest == other.digest
        import hmac

        return isinstance(other, str) and hmac.compare_digest(self.digest, derive_key(other, self.salt))

    def to_json(self) -> dict[str, str]:
        return {"salt": self.salt.hex(), "hash": self.digest.hex()}

    @classmethod
    def from_json(cls, x: dict[str, str]) -> Secret:
        return cls(salt=bytes.fromhex(x["salt"]), digest=bytes.fromhex(x["hash"]))
