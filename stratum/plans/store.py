"""Tables and payload pools of a vault, below one root path that Spark can read and write. One writer at a time."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOBS = "content_hash binary, blob binary"
POINTERS = "pool string, version string, part string, live boolean, seq bigint"


class Store:
    """Appended tables, some of them in folders by one column, and pools whose folders are swapped by pointer rows."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], folders: dict[str, str]):
        self.spark, self.root, self.schemas, self.folders = spark, root.rstrip("/"), schemas, folders

    def path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self.path(name)
        return fs.exists(p)

    def names(self, name: str) -> list[str]:
        fs, p = self.path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def remove(self, name: str) -> None:
        fs, p = self.path(name)
        fs.delete(p, True)

    def table(self, name: str) -> DataFrame:
        if not self.exists(name):
            return self.spark.createDataFrame([], self.schemas[name])
        cols = [c.split()[0] for c in self.schemas[name].split(", ")]
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}").select(*cols)

    def append(self, name: str, rows: DataFrame) -> None:
        cols = [c.split()[0] for c in self.schemas[name].split(", ")]
        out = rows.select(*cols).write.mode("append")
        (out.partitionBy(self.folders[name]) if name in self.folders else out).parquet(f"{self.root}/{name}")

    def remove_folder(self, name: str, value: str) -> None:
        """Drops all rows of one value of the column that the table's folders are made by."""
        self.remove(f"{name}/{self.folders[name]}={value}")

    def copy(self, name: str, to: str) -> None:
        """A copy of a small table, replacing an older one."""
        self.table(name).write.mode("overwrite").parquet(f"{self.root}/{to}")

    # Pools: <pool>/<version>/part=<first two hex digits>. Only folders that a pointer row calls live count, so a write
    # shows at once, with its pointers, and a crash before leaves the old state and some stray folders.

    def _pointers(self, pool: str) -> list[tuple[str, str]]:
        if not self.exists("pointers"):
            return []
        rows = self.spark.read.schema(POINTERS).parquet(f"{self.root}/pointers").filter(F.col("pool") == pool)
        live = rows.groupBy("version", "part").agg(F.max_by("live", "seq").alias("live")).filter("live")
        return sorted((r["version"], r["part"]) for r in live.collect())  # at most 256 rows for each write

    def _read(self, pool: str, folders: list[tuple[str, str]]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], BLOBS)
        return self.spark.read.schema(BLOBS).parquet(*[f"{self.root}/{pool}/{v}/part={p}" for v, p in folders])

    def _write(self, pool: str, rows: DataFrame, dead: list[tuple[str, str]]) -> int:
        version = uuid.uuid4().hex
        part = F.lower(F.substring(F.hex("content_hash"), 1, 2))
        rows.select("content_hash", "blob", part.alias("part")).repartition("part").write.partitionBy("part").parquet(f"{self.root}/{pool}/{version}")
        parts = [n.removeprefix("part=") for n in self.names(f"{pool}/{version}") if n.startswith("part=")]
        seq = time.time_ns()
        if not parts:
            self.remove(f"{pool}/{version}")
        log = [(pool, version, p, True, seq) for p in parts] + [(pool, v, p, False, seq) for v, p in dead]
        if log:
            self.spark.createDataFrame(log, POINTERS).coalesce(1).write.mode("append").parquet(f"{self.root}/pointers")  # one file: all or nothing
        return self._read(pool, [(version, p) for p in parts]).count() if parts else 0

    def pool(self, pool: str) -> DataFrame:
        """(content_hash, blob) of all payloads."""
        return self._read(pool, self._pointers(pool))

    def put(self, pool: str, rows: DataFrame) -> int:
        """Adds the payloads whose hash the pool lacks, one for each hash; returns how many."""
        fresh = rows.select("content_hash", "blob").dropDuplicates(["content_hash"])
        return self._write(pool, fresh.join(self.pool(pool).select("content_hash"), "content_hash", "left_anti"), [])

    def drop(self, pool: str, gone: DataFrame) -> int:
        """Removes the payloads of the hashes (distinct rows content_hash): only folders that hold one are written anew."""
        part = F.lower(F.substring(F.hex("content_hash"), 1, 2))
        counts = {r[0]: r[1] for r in gone.groupBy(part).count().collect()}  # at most 256 rows
        old = [(v, p) for v, p in self._pointers(pool) if p in counts]
        if old:
            self._write(pool, self._read(pool, old).join(gone.select("content_hash"), "content_hash", "left_anti"), old)
            for v, p in old:
                self.remove(f"{pool}/{v}/part={p}")
            for v in {v for v, _ in old}:
                if not any(n.startswith("part=") for n in self.names(f"{pool}/{v}")):
                    self.remove(f"{pool}/{v}")
        return sum(counts.values())

    def strays(self, pools) -> list[str]:
        """Folders of pools that no pointer calls live: what an interrupted write left."""
        out = []
        for pool in pools:
            live = set(self._pointers(pool))
            out += [f"{pool}/{v}/{n}" for v in self.names(pool) for n in self.names(f"{pool}/{v}") if n.startswith("part=") and (v, n.removeprefix("part=")) not in live]
            out += [f"{pool}/{v}" for v in self.names(pool) if not any(v == x for x, _ in live)]
        return sorted(set(out))
