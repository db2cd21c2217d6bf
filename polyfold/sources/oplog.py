"""An append-only operation log in Parquet with atomic commits, and snapshots of it.

A commit writes its rows, then publishes the next manifest by creating a file that must not exist yet. Of two
writers one succeeds; the other takes the next number, or, if what it writes depends on what it read
(transact), reads again. Readers see whole commits only, and any old version.
"""

from __future__ import annotations

import contextlib
import json
import os
import threading
import uuid
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyfold.operators import kv
from polyfold.sources.locks import Lock

FORMAT = 1
COLUMNS = "name string, key string, ord long, op string, value string, num double, ts double, data binary, vector array<float>, metadata string, flag boolean, terms string"
FIELDS = [c.split()[0] for c in COLUMNS.split(", ")]
#: Operations of one commit have numbers below this.
COMMIT = 1 << 40


#: Writers of one process take turns; those of several share a lock file where the store has a local path.
_turns: dict[str, threading.RLock] = {}


class OpLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._local = urlparse(path).scheme in ("", "file")

    def _fs(self):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _jpath(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def version(self) -> int:
        fs = self._fs()
        at = self._jpath("manifest")
        if not fs.exists(at):
            return 0
        return max((int(x.getPath().getName()[1:-5]) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json") and x.getPath().getName().startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        v = self.version() if version is None else version
        if not v:
            return {"format": FORMAT, "version": 0, "batches": []}
        fs = self._fs()
        stream = fs.open(self._jpath("manifest", f"v{v:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        m = json.loads(text)
        if m["format"] > FORMAT:
            raise ValueError(f"the store has format {m['format']}; this version reads up to {FORMAT}")
        return m

    def _publish(self, m: dict[str, Any]) -> bool:
        """Creates the manifest's file; False if another writer was first."""
        name = f"v{m['version']:012d}.json"
        if self._local:
            at = f"{urlparse(self.path).path}/manifest"
            os.makedirs(at, exist_ok=True)
            part = f"{at}/.{uuid.uuid4().hex}"
            with open(part, "w") as f:
                json.dump(m, f)
            try:
                os.link(part, f"{at}/{name}")  # whole or not at all, and never over another's
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            return True
        try:
            out = self._fs().create(self._jpath("manifest", name), False)
        except Exception as e:  # py4j wraps the file system's error
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(json.dumps(m).encode())
        out.close()
        return True

    @contextlib.contextmanager
    def _turn(self) -> Iterator[None]:
        """Keeps writers apart. Only for speed: a commit is right without it, but may have to be made again."""
        with _turns.setdefault(self.path, threading.RLock()):
            if not self._local or getattr(self, "_held", False):
                yield
                return
            with Lock(urlparse(self.path).path, "commit"):
                self._held = True
                try:
                    yield
                finally:
                    self._held = False

    def _write(self, rows: DataFrame | list[dict[str, Any]], folder: str = "data") -> str:
        if isinstance(rows, list):
            full = [tuple({"ord": i, "op": "put", **r}.get(c) for c in FIELDS) for i, r in enumerate(rows)]
            rows = self.spark.createDataFrame(full, COLUMNS).coalesce(1)
        batch = f"{'c-' if folder == 'compacted' else ''}{uuid.uuid4().hex}"
        rows.select(*FIELDS).write.parquet(f"{self.path}/{folder}/b={batch}")
        return batch

    def append(self, rows: DataFrame | list[dict[str, Any]], attempts: int = 100) -> int:
        """Commits rows as one batch, whatever else is committed meanwhile; returns its version."""
        batch = self._write(rows)
        with self._turn():
            for _ in range(attempts):
                m = self.manifest()
                m["version"] += 1
                m["batches"].append([batch, m["version"]])
                if self._publish(m):
                    return m["version"]
        raise RuntimeError("too many writers at once")

    def transact(self, build: Callable[[], tuple[list[dict[str, Any]], Any]], attempts: int = 100) -> Any:
        """Commits rows that depend on what is stored: build reads, and gives rows and a result, which is returned.

        The commit takes the version after the one that was there before build read; if another writer has taken it, the
        batch is deleted and build runs again. No rows: nothing is committed.
        """
        with self._turn():
            for _ in range(attempts):
                m = self.manifest()
                rows, result = build()
                if not rows:
                    return result
                batch = self._write(rows)
                m["version"] += 1
                m["batches"].append([batch, m["version"]])
                if self._publish(m):
                    return result
                self._fs().delete(self._jpath("data", f"b={batch}"), True)
        raise RuntimeError("too many writers at once")

    def rows(self, version: int | None = None) -> DataFrame:
        """All operations up to a version, with their global order in seq."""
        m = self.manifest(version)
        if not m["batches"]:
            return self.spark.createDataFrame([], COLUMNS).withColumn("seq", F.lit(0).cast("long"))
        parts = []
        for folder, batches in (("data", [b for b, _ in m["batches"] if not b.startswith("c-")]), ("compacted", [b for b, _ in m["batches"] if b.startswith("c-")])):
            if batches:
                at = f"{self.path}/{folder}"
                parts.append(self.spark.read.schema(f"{COLUMNS}, b string").option("basePath", at).parquet(*[f"{at}/b={b}" for b in batches]))
        d = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        order = self.spark.createDataFrame(m["batches"], "b string, v long")
        return d.join(F.broadcast(order), "b").withColumn("seq", F.col("v") * COMMIT + F.col("ord")).drop("b", "v")

    def snapshot(self, name: str | None = None, version: int | None = None, unique: bool = False) -> DataFrame:
        """The last put of each key since its namespace was last cleared.

        Rows are grouped by name and key themselves, so that a filter on the key reaches the scan. unique: keys are put
        once and never deleted, as in logs; then nothing is aggregated.
        """
        d = self.rows(version)
        if name is not None:
            d = d.where(F.col("name") == name)
        cleared = d.where("op = 'clear'").groupBy("name").agg(F.max("seq").alias("_c"))
        d = d.where("op <> 'clear'").join(F.broadcast(cleared), "name", "left").where("_c is null or seq > _c").drop("_c")
        d = d.where("op = 'put'") if unique else kv.latest(d, ["name", "key"])
        return d.select("name", "key", "seq", *[c for c in FIELDS if c not in ("name", "key", "ord", "op")])

    def config(self, name: str | None = None) -> DataFrame:
        """name, key, num, ts: the last configuration row of each key; clear and compact leave them."""
        d = self.rows().where("op = 'config'")
        if name is not None:
            d = d.where(F.col("name") == name)
        last = d.groupBy("name", "key").agg(F.max_by(F.struct("num", "ts"), "seq").alias("r"))
        return last.select("name", "key", "r.num", "r.ts")

    def compact(self) -> int:
        """Writes the snapshot as one batch that replaces those that it was made of; later ones stay.

        It stands in a folder of its own, so followers of the commits don't see its rows again.
        """
        from pyspark.sql import Window

        m = self.manifest()
        # Order numbers keep their order: by the old sequence within each namespace.
        s = self.snapshot(version=m["version"])
        s = s.withColumn("ord", F.row_number().over(Window.partitionBy("name").orderBy("seq")).cast("long")).withColumn("op", F.lit("put"))
        kept = self.config().withColumn("ord", F.lit(0).cast("long")).withColumn("op", F.lit("config"))
        for c in FIELDS:
            if c not in kept.columns:
                kept = kept.withColumn(c, F.lit(None).cast(s.schema[c].dataType))
        batch = self._write(s.select(*FIELDS).unionByName(kept.select(*FIELDS)), "compacted")
        with self._turn():
            for _ in range(100):
                now = self.manifest()
                new = {"format": FORMAT, "version": now["version"] + 1, "batches": [[batch, m["version"]], *(x for x in now["batches"] if x not in m["batches"])]}
                if self._publish(new):
                    return new["version"]
        raise RuntimeError("too many writers at once")
