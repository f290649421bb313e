"""A vault of snapshots: Parquet tables, pools of payloads and an append-only registry. A snapshot shows once its registry row does."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import binary as B
from stratum.functions import paths as P
from stratum.operators import archives, compare, diff, integrity, pool, registry
from stratum.plans import pictures
from stratum.plans.store import Store
from stratum.sources import trees

CELLS = "array<struct<cx:int,cz:int,compression:smallint,timestamp:bigint,external:boolean,content_hash:binary>>"
#: refs_id names the folders of a snapshot's references, so that a rewrite of them is a new registry row.
SCHEMAS = {
    "snapshots": "snapshot_id string, refs_id string, label string, world_name string, timestamp_ms bigint, original_timestamp_ms bigint, last_played_ms bigint, mc_version string, data_version int, chunk_count bigint, region_count bigint, file_count bigint, new_chunk_count bigint, new_file_count bigint, state string, seq bigint",
    "chunk_refs": "refs_id string, dimension_key string, rx int, rz int, cx int, cz int, compression smallint, timestamp bigint, content_hash binary",
    "file_refs": "refs_id string, relative_path string, sha256 binary",
    "errors": "snapshot_id string, rel string, error string",
    "region_cache": f"region_sha binary, cells {CELLS}",
    "tiles": "content_hash binary, mode string, rgb binary",
    "sidecars": "snapshot_id string, dimension_key string, mode string, name string, width int, height int, png binary",
    "log_snapshots": "log_snapshot_id string, label string, timestamp_ms bigint, source_path string, server_count bigint, file_count bigint, new_file_count bigint, state string, seq bigint",
    "log_refs": "log_snapshot_id string, server string, path string, sha256 binary, size bigint, mtime_ms bigint",
}
FOLDERS = {"chunk_refs": "refs_id", "file_refs": "refs_id", "log_refs": "log_snapshot_id", "sidecars": "snapshot_id"}
POOLS = ("pool_chunks", "pool_files", "pool_logs")
REGION = ["dimension_key", "rx", "rz"]


class Collision(ValueError):
    """Another snapshot has that label and time."""


class NoWorld(ValueError):
    """The tree has neither a level.dat nor a region file."""


class LiveWorld(ValueError):
    """The world's lock file is empty and new: a server may be writing it."""


class RoundTripFailed(ValueError):
    """What a snapshot would restore differs from its source."""


def _scheme(blob: str):
    return F.conv(F.hex(F.substring(blob, 1, 1)), 16, 10).cast("int")


class Vault:
    """All tables live below one root path that Spark can read and write. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root, SCHEMAS, FOLDERS)

    # Registry

    def table(self, name: str) -> DataFrame:
        return self.store.pool(name) if name in POOLS else self.store.table(name)

    def registry(self) -> DataFrame:
        return registry.current(self.table("snapshots"))

    def snapshots(self, limit: int | None = None) -> DataFrame:
        return registry.newest_first(self.registry(), "timestamp_ms", "snapshot_id", limit)

    def resolve(self, name: str) -> str | None:
        """The id of an exact id, a label (its newest) or the start of an id (its newest)."""
        return registry.find(self.registry(), name, "snapshot_id", "label", "timestamp_ms")

    def latest(self, world: str) -> str | None:
        row = registry.latest_per(self.registry().filter(F.col("world_name") == world), "world_name", "timestamp_ms", "snapshot_id").first()
        return row["snapshot_id"] if row else None

    def _refs_id(self, sid: str) -> str:
        """The folder of a snapshot's references; a snapshot not in the registry has its own id's."""
        row = self.registry().filter(F.col("snapshot_id") == sid).select("refs_id").first()
        return row["refs_id"] if row else sid

    def _live(self, name: str) -> DataFrame:
        return self.table(name).join(self.registry().select("refs_id"), "refs_id", "left_semi")

    def _amend(self, rows: DataFrame) -> None:
        """Appends registry rows anew, in one write. There is at most one for each snapshot."""
        self.store.append("snapshots", self.spark.createDataFrame(rows.withColumn("seq", F.lit(time.time_ns())).collect(), rows.schema))

    def _change(self, sid: str, **values) -> None:
        rows = self.registry().filter(F.col("snapshot_id") == sid)
        for k, v in values.items():
            rows = rows.withColumn(k, F.lit(v).cast(rows.schema[k].dataType))
        self._amend(rows)

    def delete(self, sid: str) -> None:
        self._change(sid, state="deleted")

    def rename(self, sid: str, label: str) -> None:
        self._change(sid, label=label)

    def backup_registry(self) -> str:
        """Copies the registry to snapshots.bak, replacing an older copy."""
        self.store.copy("snapshots", "snapshots.bak")
        return f"{self.store.root}/snapshots.bak"

    # Snapshots

    def snapshot(self, world: str | DataFrame, label: str | None = None, world_name: str = "world", timestamp_ms: int | None = None, exclude=P.DEFAULT_EXCLUDES, verify_roundtrip: bool = True, allow_live: bool = True, whole_files: bool = False) -> str:
        """Takes a snapshot of a tree (its path, or rows (rel, size, modified_ms, content)): cells and other files, new payloads only into the pools.

        Regions whose bytes the cache knows, with every payload still in the pool, aren't parsed. All others are parsed
        once for references; only regions with a hash that the pool lacks are read again for payloads. With
        ``whole_files``, regions are kept as files. With ``verify_roundtrip``, what the snapshot would restore is compared
        with the tree before the snapshot shows.
        """
        sid = uuid.uuid4().hex
        tree = trees.read_tree(self.spark, world) if isinstance(world, str) else world
        regions = trees.region_files(tree)
        facts = tree.agg(F.count_if(F.col("rel").rlike(r"^([^/]+/)?level\.dat$")).alias("levels"), F.max(F.when((F.col("rel") == "session.lock") & (F.col("size") == 0), F.col("modified_ms"))).alias("lock")).first()
        shape = regions.agg(F.count("*").alias("n"), F.count_distinct(*REGION).alias("keys"), F.max("modified_ms").alias("newest")).first()
        if not facts["levels"] and not shape["n"]:
            raise NoWorld(f"{label or world_name}: no level.dat and no region file")
        if not allow_live and facts["lock"] and facts["lock"] > time.time() * 1000 - 60_000:
            raise LiveWorld("session.lock is empty and less than a minute old")
        if shape["n"] > shape["keys"]:
            raise ValueError("two region files of one folder have the same coordinates")
        if whole_files:
            regions = regions.limit(0)

        self._write_refs(sid, regions, tree)
        own = self.table("chunk_refs").filter(F.col("refs_id") == sid)
        lacking = pool.unseen(own.select("content_hash"), self.table("pool_chunks"), "content_hash")
        new_chunks = 0
        if lacking.limit(1).count():
            again = regions.join(own.join(lacking, "content_hash", "left_semi").select(*REGION).distinct(), REGION, "left_semi")
            cells = trees.scanned_cells(again.withColumn("scan", B.scan_region("content")), tree)
            blob = F.concat(F.unhex(F.lpad(F.hex(P.masked_compression(F.col("compression")).cast("int")), 2, "0")), F.col("payload"))
            new_chunks = self.store.put("pool_chunks", cells.select("content_hash", blob.alias("blob")))

        files = tree.join(regions.select("rel"), "rel", "left_anti").filter(~F.col("rel").rlike(trees.SIDE_PATTERN) & ~P.matches_any(F.col("rel"), exclude))
        if whole_files:
            files = tree.filter(~P.matches_any(F.col("rel"), exclude))
        files = files.withColumn("sha256", F.unhex(F.sha2("content", 256)))
        self.store.append("file_refs", files.select(F.lit(sid).alias("refs_id"), F.col("rel").alias("relative_path"), "sha256"))
        new_files = self.store.put("pool_files", files.select(F.col("sha256").alias("content_hash"), F.col("content").alias("blob")))

        if verify_roundtrip:
            counts = self._against(sid, tree, exclude).counts()
            if compare.differs(counts):
                for name in ("chunk_refs", "file_refs"):
                    self.store.remove_folder(name, sid)
                raise RoundTripFailed(str(counts))
        info = self._level_info(files.select("rel", "content"))
        played = info["last_played_ms"] if info and (info["last_played_ms"] or 0) > 0 else None
        when = timestamp_ms or played or shape["newest"] or int(time.time() * 1000)
        total = own.agg(F.count("*"), F.count_distinct(*REGION)).first()
        n_files = self.table("file_refs").filter(F.col("refs_id") == sid).count()
        row = (sid, sid, label, world_name, when, None, played, info["mc_version"] if info else None, info["data_version"] if info else None, total[0], total[1], n_files, new_chunks, new_files, "committed", time.time_ns())
        self.store.append("snapshots", self.spark.createDataFrame([row], SCHEMAS["snapshots"]))
        return sid

    def _write_refs(self, sid: str, regions: DataFrame, tree: DataFrame) -> None:
        named = regions.withColumn("region_sha", F.unhex(F.sha2("content", 256)))
        path = f"{self.store.root}/staging/{sid}"
        fresh, known = named, None
        if self.store.exists("region_cache"):
            # Cached regions of this tree whose payloads the pool all has: few columns, written once and read twice.
            cache = self._cache().join(named.select("region_sha").distinct(), "region_sha", "left_semi")
            hits = named.select(*REGION, "region_sha").join(self._complete(cache), "region_sha").select(*REGION, "region_sha", "cells")
            hits.write.parquet(f"{path}/hits")
            known = self.spark.read.schema(hits.schema).parquet(f"{path}/hits")
            fresh = named.join(known.select("region_sha").distinct(), "region_sha", "left_anti")
        # One parse of each other region: references and errors of the same pass.
        scan = trees.scanned_refs(fresh)
        scan.write.parquet(f"{path}/fresh")
        read = self.spark.read.schema(scan.schema).parquet(f"{path}/fresh")
        new = read.filter("error is null")
        every = new.select(*REGION, "cells") if known is None else new.select(*REGION, "cells").unionByName(known.select(*REGION, "cells"))
        rows = every.select(*REGION, F.explode("cells").alias("c")).select(*REGION, "c.*")
        rows = rows.withColumn("wx", P.world_coord(F.col("rx"), F.col("cx"))).withColumn("wz", P.world_coord(F.col("rz"), F.col("cz")))
        refs = rows.filter("not external")
        facts = read.agg(F.count_if(F.col("error").isNotNull()).alias("bad"), F.count_if(F.exists("cells", lambda c: c["external"])).alias("outside"), F.count("*").alias("n")).first()
        if facts["outside"]:  # cached regions have no payloads outside
            outside = rows.filter("external").drop("content_hash").join(trees.side_files(tree), ["dimension_key", "wx", "wz"], "left")
            outside = outside.withColumn("content_hash", B.chunk_hash("compression", F.coalesce("mcc", F.lit(b"")))).drop("mcc")
            refs = refs.unionByName(outside.select(*rows.columns))
        self.store.append("chunk_refs", refs.withColumn("refs_id", F.lit(sid)))
        if facts["bad"]:
            self.store.append("errors", read.filter("error is not null").withColumn("snapshot_id", F.lit(sid)))
        if facts["n"] > facts["bad"]:
            inside = new.filter(~F.exists("cells", lambda c: c["external"])).select("region_sha", "cells").dropDuplicates(["region_sha"])
            self.store.append("region_cache", inside.join(self._cache().select("region_sha"), "region_sha", "left_anti"))
        self.store.remove(f"staging/{sid}")

    @staticmethod
    def _level_info(files: DataFrame):
        """Version and time of the first level.dat at the root, else one folder down; at most one row."""
        level = files.filter(F.col("rel").rlike(r"^([^/]+/)?level\.dat$")).withColumn("info", B.world_info(B.decompress(F.lit(1), "content")))
        return level.filter("info is not null").orderBy(archives.depth(F.col("rel")), "rel").select("info.*").first()

    def cells_of(self, sid: str) -> DataFrame:
        """Only the snapshot's own folder of references is read."""
        return self.table("chunk_refs").filter(F.col("refs_id") == self._refs_id(sid)).drop("refs_id")

    def files_of(self, sid: str, prefix: str = "", suffix: str = "") -> DataFrame:
        rows = self.table("file_refs").filter(F.col("refs_id") == self._refs_id(sid))
        return rows.filter(P.prefix_suffix(F.col("relative_path"), prefix, suffix)).select("relative_path", "sha256")

    def stream_files(self, sid: str, prefix: str = "", suffix: str = "") -> DataFrame:
        """(relative_path, sha256, content) of the files whose payload the pool has."""
        return self.files_of(sid, prefix, suffix).join(self.table("pool_files"), F.col("sha256") == F.col("content_hash")).select("relative_path", "sha256", F.col("blob").alias("content"))

    def read_file(self, sid: str, path: str) -> bytes | None:
        row = self.stream_files(sid).filter(F.col("relative_path") == path).select("content").first()
        return bytes(row[0]) if row else None

    # Region cache

    def _cache(self) -> DataFrame:
        return self.table("region_cache").dropDuplicates(["region_sha"])

    def _complete(self, cache: DataFrame) -> DataFrame:
        """The cached regions whose payloads are all in the pool; regions without cells among them."""
        hashes = cache.select("region_sha", F.explode("cells.content_hash").alias("content_hash"))
        broken = pool.complete_entries(hashes, self.table("pool_chunks"), "region_sha", "content_hash").filter("not valid")
        return cache.join(broken.select("region_sha"), "region_sha", "left_anti")

    def cache_size(self) -> dict[str, int]:
        row = self._cache().agg(F.count("*"), F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()
        return {"regions": row[0], "cells": row[1]}

    def backfill_cache(self, world: str | DataFrame, sid: str) -> dict[str, int]:
        """Caches the regions of a tree from a snapshot's references, without parsing them: those with cells in the snapshot and none outside."""
        tree = trees.read_tree(self.spark, world) if isinstance(world, str) else world
        named = trees.region_files(tree).select(*REGION, F.unhex(F.sha2("content", 256)).alias("region_sha"))
        known = named.join(self._cache().select("region_sha"), "region_sha", "left_semi").count()
        cell = F.struct("cx", "cz", "compression", "timestamp", (F.col("compression").bitwiseAND(F.lit(128)) != 0).alias("external"), "content_hash")
        grouped = self.cells_of(sid).groupBy(*REGION).agg(F.sort_array(F.collect_list(cell)).alias("cells"))  # at most 1024
        fresh = named.join(self._cache().select("region_sha"), "region_sha", "left_anti").join(grouped, REGION, "left").withColumn("fits", F.coalesce(~F.exists("cells", lambda c: c["external"]), F.lit(False)))
        out = fresh.agg(F.count_if("fits").alias("added"), F.count_if(F.col("cells").isNull()).alias("missing"), F.count_if(F.col("cells").isNotNull() & ~F.col("fits")).alias("external")).first().asDict()
        self.store.append("region_cache", fresh.filter("fits").select("region_sha", "cells").dropDuplicates(["region_sha"]))
        return out | {"already": known}

    # Differences

    def diff(self, old: str, new: str) -> DataFrame:
        """Changed cells by world coordinates, in the order of their keys, from the two snapshots' references alone."""
        keys = [*REGION, "cx", "cz"]
        out = diff.full_diff(self.cells_of(old), self.cells_of(new), keys, "content_hash")
        out = out.withColumn("wx", P.world_coord(F.col("rx"), F.col("cx"))).withColumn("wz", P.world_coord(F.col("rz"), F.col("cz")))
        return out.orderBy(*keys)

    def diff_files(self, old: str, new: str) -> DataFrame:
        """relative_path, kind, old_hash, new_hash of the files that differ."""
        return diff.full_diff(self.files_of(old), self.files_of(new), ["relative_path"], "sha256")

    def diff_whole_files(self, old: str, new: str) -> DataFrame:
        """Changed cells between snapshots taken with ``whole_files``: only region files whose bytes differ are read."""
        changed = self.diff_files(old, new)
        region = changed.filter(F.col("relative_path").rlike(P.REGION_PATTERN))
        side = changed.filter(F.col("relative_path").rlike(trees.SIDE_PATTERN))
        # A payload beside a region pulls in that region.
        at = lambda i: F.shiftright(F.regexp_extract("relative_path", trees.SIDE_PATTERN, i).cast("int"), 5).cast("string")
        folder = F.regexp_replace("relative_path", "[^/]*$", "")
        pulled = side.select(F.explode(F.array(*[F.concat(folder, F.lit("r."), at(1), F.lit("."), at(2), F.lit(e)) for e in (".mca", ".mcr")])).alias("relative_path"))
        wanted = region.select("relative_path").unionByName(pulled).distinct()

        def cells(sid):
            files = self.stream_files(sid).select(F.col("relative_path").alias("rel"), F.length("content").cast("long").alias("size"), F.lit(0).cast("long").alias("modified_ms"), "content")
            return trees.cells(files.join(wanted.withColumnRenamed("relative_path", "rel"), "rel", "left_semi").unionByName(files.filter(F.col("rel").rlike(trees.SIDE_PATTERN))))[0]

        out = diff.full_diff(cells(old), cells(new), [*REGION, "cx", "cz"], "content_hash")
        return out.withColumn("wx", P.world_coord(F.col("rx"), F.col("cx"))).withColumn("wz", P.world_coord(F.col("rz"), F.col("cz")))

    def version_change(self, old: str, new: str) -> dict:
        """Labels and versions of two snapshots; ``changed`` if both versions are known and differ."""
        rows = {r["snapshot_id"]: r for r in self.registry().filter(F.col("snapshot_id").isin(old, new)).collect()}
        a, b = rows[old], rows[new]
        known = lambda c: a[c] is not None and b[c] is not None and a[c] != b[c]
        return {f"{side}_{c}": r[c] for side, r in (("old", a), ("new", b)) for c in ("label", "mc_version", "data_version")} | {"version_changed": known("mc_version") or known("data_version")}

    # Restoring

    def restored(self, sid: str) -> DataFrame:
        """(rel, content) of a snapshot's files: regions packed again, external payloads beside them. Missing blobs fail."""
        cells = self.cells_of(sid).join(self.table("pool_chunks"), "content_hash", "left")
        cells = cells.withColumn("payload", F.when(F.col("blob").isNull(), F.raise_error(F.concat(F.lit("missing payload "), F.hex("content_hash")))).otherwise(F.expr("substring(blob, 2)")))
        outside = F.col("compression").bitwiseAND(F.lit(128)) != 0
        cell = F.struct("cx", "cz", "timestamp", "compression", F.when(outside, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))
        folder = F.when(F.col("dimension_key") == ".", "").otherwise(F.concat("dimension_key", F.lit("/")))
        regions = cells.groupBy(*REGION).agg(B.pack_region(F.collect_list(cell)).alias("content"))  # at most 1024 cells
        regions = regions.select(F.concat(folder, F.lit("r."), F.col("rx").cast("string"), F.lit("."), F.col("rz").cast("string"), F.lit(".mca")).alias("rel"), "content")
        side = cells.filter(outside).select(F.concat(folder, F.lit("c."), P.world_coord(F.col("rx"), F.col("cx")).cast("string"), F.lit("."), P.world_coord(F.col("rz"), F.col("cz")).cast("string"), F.lit(".mcc")).alias("rel"), F.col("payload").alias("content"))
        files = self.files_of(sid).join(self.table("pool_files"), F.col("sha256") == F.col("content_hash"), "left")
        files = files.select(F.col("relative_path").alias("rel"), F.when(F.col("blob").isNull(), F.raise_error(F.concat(F.lit("missing file "), "relative_path"))).otherwise(F.col("blob")).alias("content"))
        return regions.unionByName(side).unionByName(files)

    def restore(self, sid: str, dest: str, paths=None) -> None:
        """Writes the files, or those at or below the given paths, under a folder that the driver and all executors see at one path."""
        out = self.restored(sid)
        write_files(out if paths is None else out.filter(P.under_any(F.col("rel"), paths)), dest)

    def _against(self, sid: str, tree: DataFrame, exclude) -> compare.Comparison:
        back = self.restored(sid).select("rel", F.length("content").cast("long").alias("size"), F.lit(0).cast("long").alias("modified_ms"), "content")
        return compare.compare_trees(tree, back, exclude)

    def roundtrip(self, sid: str, world: str | DataFrame, exclude=P.DEFAULT_EXCLUDES) -> compare.Comparison:
        """What a snapshot restores against a tree: regions, cells and all other files."""
        return self._against(sid, trees.read_tree(self.spark, world) if isinstance(world, str) else world, exclude)

    # Upkeep

    def retime(self, sid: str, timestamp_ms: int) -> None:
        """Moves a snapshot in time; the first move keeps the original, and a generated label follows."""
        bad = self.retime_many({sid: timestamp_ms})
        if bad:
            raise Collision(f"another snapshot has that label at {timestamp_ms}")

    def retime_many(self, times: dict[str, int]) -> list[str]:
        """Moves snapshots in time with one registry write; returns the ids left where they are, as label and time are taken."""
        current = self.registry()
        wanted = self.spark.createDataFrame(list(times.items()), "snapshot_id string, nt bigint")
        plan = current.join(wanted, "snapshot_id").filter("timestamp_ms <> nt").withColumn("nl", P.retitled(F.col("label"), F.col("world_name"), F.col("timestamp_ms"), F.col("nt")))
        # The registry as it will be: two moves may collide with each other too.
        after = current.join(plan.select("snapshot_id", "nt", "nl"), "snapshot_id", "left")
        after = after.select("snapshot_id", F.when(F.col("nt").isNull(), F.col("label")).otherwise(F.col("nl")).alias("label"), F.coalesce("nt", "timestamp_ms").alias("timestamp_ms"))
        bad = [r[0] for r in registry.collisions(plan, after, "snapshot_id", "label", "timestamp_ms", "nl", "nt").select("snapshot_id").distinct().collect()]
        moved = plan.filter(~F.col("snapshot_id").isin(bad)).withColumn("original_timestamp_ms", F.coalesce("original_timestamp_ms", "timestamp_ms")).withColumn("timestamp_ms", F.col("nt")).withColumn("label", F.col("nl"))
        self._amend(moved.select(*current.columns))
        return sorted(bad)

    def _recovered(self) -> DataFrame:
        """(snapshot_id, recovered): when the world of each snapshot that doesn't know it was last played, from its level.dat in the pool."""
        lacking = self.registry().filter("coalesce(last_played_ms, 0) <= 0").select("snapshot_id", "refs_id")
        level = self.table("file_refs").filter(F.col("relative_path").rlike(r"^([^/]+/)?level\.dat$")).join(lacking, "refs_id")
        read = level.join(self.table("pool_files"), F.col("sha256") == F.col("content_hash")).withColumn("played", B.world_info(B.decompress(F.lit(1), "blob"))["last_played_ms"]).filter("played > 0")
        return registry.first_per(read, "snapshot_id", archives.depth(F.col("relative_path")), "relative_path").select("snapshot_id", F.col("played").alias("recovered"))

    def repair_plan(self) -> DataFrame:
        """The registry with ``target`` (when last played), ``recovered``, ``action`` (delete, retime, keep) and ``new_label``."""
        rows = self.registry().join(self._recovered(), "snapshot_id", "left")
        rows = rows.withColumn("target", F.coalesce(F.when(F.col("last_played_ms") > 0, F.col("last_played_ms")), "recovered"))
        return registry.repair_plan(rows, "snapshot_id", "world_name", "timestamp_ms", "target", "label")

    def repair_timestamps(self, dry_run: bool = True) -> dict[str, int]:
        """Puts each snapshot at the time its world was last played: of several of one world and time one stays. One registry write."""
        plan = self.spark.createDataFrame(self.repair_plan().collect(), self.repair_plan().schema)  # one row a snapshot
        count = lambda cond: F.count_if(F.expr(cond))
        out = plan.agg(
            F.count("*").alias("scanned"), count("action = 'delete'").alias("to_delete"), count("action = 'retime'").alias("to_retime"), count("action = 'keep' and target is not null").alias("already_correct"),
            count("target is null").alias("no_last_played"), count("recovered is not null").alias("recovered"),
        ).first().asDict()
        if not dry_run:
            rows = plan.withColumn("last_played_ms", F.coalesce("target", "last_played_ms")).withColumn("state", F.when(F.col("action") == "delete", "deleted").otherwise(F.col("state")))
            move = F.col("action") == "retime"
            rows = rows.withColumn("original_timestamp_ms", F.when(move, F.coalesce("original_timestamp_ms", "timestamp_ms")).otherwise(F.col("original_timestamp_ms")))
            rows = rows.withColumn("timestamp_ms", F.when(move, F.col("target")).otherwise(F.col("timestamp_ms"))).withColumn("label", F.col("new_label"))
            self._amend(rows.filter("action <> 'keep' or recovered is not null").select(*self.registry().columns))
        return out

    def migrate(self, dry_run: bool = True) -> dict[str, int]:
        """Turns region files that snapshots hold as whole files into cells. Files at the root, unreadable ones and those with payloads outside stay.

        New references go to new folders, and one registry write points to them.
        """
        live = self._live("file_refs")
        plan = archives.migration(live, "relative_path").filter("action = 'migrate'")
        blobs = plan.select("sha256").distinct().join(self.table("pool_files"), F.col("sha256") == F.col("content_hash")).withColumn("scan", B.scan_region("blob")).select("sha256", "scan")
        plan = plan.join(blobs, "sha256", "left")
        state = F.when(F.col("scan").isNull(), "missing").when(F.col("scan.error").isNotNull(), "unreadable").when(F.exists("scan.cells", lambda c: c["external"]), "external").otherwise("migrate")
        plan = plan.withColumn("state", state)
        found = {r[0]: r[1] for r in plan.groupBy("state").count().collect()}
        out = {"snapshots": plan.select("refs_id").distinct().count(), "files": sum(found.values()), "migrated": 0 if dry_run else found.get("migrate", 0), **{k: found.get(k, 0) for k in ("missing", "unreadable", "external")}}
        if dry_run or not found.get("migrate"):
            return out
        good = plan.filter("state = 'migrate'")
        cells = good.select("refs_id", "dimension_key", F.col("rx").cast("int").alias("rx"), F.col("rz").cast("int").alias("rz"), F.explode("scan.cells").alias("c")).select("refs_id", *REGION, "c.*")
        cells = cells.withColumn("content_hash", B.chunk_hash("compression", "payload"))
        blob = F.concat(F.unhex(F.lpad(F.hex(P.masked_compression(F.col("compression")).cast("int")), 2, "0")), F.col("payload"))
        self.store.put("pool_chunks", cells.select("content_hash", blob.alias("blob")))
        mark = uuid.uuid4().hex
        touched = good.select("refs_id").distinct()
        renamed = F.concat_ws("-", "refs_id", F.lit(mark)).alias("refs_id")
        old = self.table("chunk_refs").join(touched, "refs_id", "left_semi")
        names = [c for c in old.columns if c != "refs_id"]
        self.store.append("chunk_refs", old.unionByName(cells.select("refs_id", *names)).select(renamed, *names))
        rest = live.join(touched, "refs_id", "left_semi").join(good.select("refs_id", "relative_path"), ["refs_id", "relative_path"], "left_anti")
        self.store.append("file_refs", rest.select(renamed, "relative_path", "sha256"))
        ids = self.registry().join(touched, "refs_id", "left_semi").withColumn("refs_id", F.concat_ws("-", "refs_id", F.lit(mark)))
        sizes = self.table("chunk_refs").groupBy("refs_id").agg(F.count("*").alias("c"), F.count_distinct(*REGION).alias("r"))
        files = self.table("file_refs").groupBy("refs_id").agg(F.count("*").alias("f"))
        ids = ids.join(sizes, "refs_id", "left").join(files, "refs_id", "left")
        for name, c in (("chunk_count", "c"), ("region_count", "r"), ("file_count", "f")):
            ids = ids.withColumn(name, F.coalesce(c, F.lit(0)).cast("long"))
        self._amend(ids.select(*self.registry().columns))
        return out

    def gc(self) -> dict[str, int]:
        """Drops payloads that no committed snapshot refers to, and references of deleted ones; returns how many payloads by pool.

        Only pool folders that hold such a payload are written anew.
        """
        live = {r[0] for r in self.registry().select("refs_id").collect()}
        dead = {r[0] for r in self.table("snapshots").select("refs_id").distinct().collect()} - live
        for refs_id in sorted(dead):
            for name in ("chunk_refs", "file_refs"):
                self.store.remove_folder(name, refs_id)
        logs = registry.current(self.table("log_snapshots"), "log_snapshot_id").select("log_snapshot_id")
        refs = {
            "pool_chunks": self._live("chunk_refs").select("content_hash"), "pool_files": self._live("file_refs").select(F.col("sha256").alias("content_hash")),
            "pool_logs": self.table("log_refs").join(logs, "log_snapshot_id", "left_semi").select(F.col("sha256").alias("content_hash")),
        }
        return {name: self.store.drop(name, pool.orphans(self.table(name).select("content_hash"), r, "content_hash")) for name, r in refs.items()}

    def gc_tiles(self) -> int:
        """Drops tiles of payloads that the pool no longer has."""
        gone = pool.orphans(self.table("tiles"), self.table("pool_chunks"), "content_hash").count()
        if gone:
            keep = self.table("tiles").join(self.table("pool_chunks").select("content_hash"), "content_hash", "left_semi")
            keep.write.mode("overwrite").parquet(f"{self.store.root}/tiles.new")
            self.store.remove("tiles")
            fs, p = self.store.path("tiles.new")
            fs.rename(p, self.store.path("tiles")[1])  # tiles can be made again: a crash here loses no data
        return gone

    def verify(self, repair: bool = False) -> dict[str, int]:
        """Hashes every payload again and follows every reference. With ``repair`` corrupt payloads go, so that a later snapshot stores them anew."""
        chunk_fine = B.chunk_hash(_scheme("blob"), F.expr("substring(blob, 2)")) == F.col("content_hash")
        file_fine = F.unhex(F.sha2("blob", 256)) == F.col("content_hash")
        out: dict[str, int] = {}
        for name, fine, title in (("pool_chunks", chunk_fine, "chunks"), ("pool_files", file_fine, "files"), ("pool_logs", file_fine, "logs")):
            row = integrity.verify_counts(self.table(name), fine).first()
            out |= {f"ok_{title}": row["ok"], f"corrupt_{title}": row["corrupt"]}
            if repair and row["corrupt"]:
                self.store.drop(name, self.table(name).filter(~F.coalesce(fine, F.lit(False))).select("content_hash").distinct())
        chunks, files = self.table("pool_chunks"), self.table("pool_files")
        refs, frefs = self._live("chunk_refs"), self._live("file_refs").select(F.col("sha256").alias("content_hash"))
        return out | {
            "missing_referenced": pool.missing_references(refs, chunks, "content_hash").count(), "missing_files": pool.missing_references(frefs, files, "content_hash").count(),
            "orphan_chunks": pool.orphans(chunks, refs, "content_hash").count(), "orphan_files": pool.orphans(files, frefs, "content_hash").count(), "missing_manifests": self._registry_state().filter("state = 'dangling'").count(),
        }

    def _registry_state(self) -> DataFrame:
        """key and state of registry rows against folders of references: dangling rows have lost theirs, orphan folders have no row."""
        rows = self.registry().filter("chunk_count + file_count > 0").select(F.col("refs_id").alias("key"))
        held = self.table("chunk_refs").select("refs_id").union(self.table("file_refs").select("refs_id")).distinct().withColumnRenamed("refs_id", "key")
        return integrity.reconcile(rows, held.join(self._known_empty(), "key", "left_anti"), "key")

    def _known_empty(self) -> DataFrame:
        """Folders that belong to deleted snapshots, which gc removes, or to committed ones without content."""
        return self.table("snapshots").select(F.col("refs_id").alias("key")).distinct().join(self.registry().filter("chunk_count + file_count > 0").select(F.col("refs_id").alias("key")), "key", "left_anti")

    def _log_state(self) -> DataFrame:
        rows = registry.current(self.table("log_snapshots"), "log_snapshot_id")
        held = self.table("log_refs").select(F.col("log_snapshot_id").alias("key")).distinct()
        deleted = self.table("log_snapshots").select(F.col("log_snapshot_id").alias("key")).distinct().join(rows.select(F.col("log_snapshot_id").alias("key")), "key", "left_anti")
        return integrity.reconcile(rows.filter("file_count > 0").select(F.col("log_snapshot_id").alias("key")), held.join(deleted, "key", "left_anti"), "key")

    def fsck(self, repair: bool = False) -> dict[str, int]:
        """Strays of interrupted writes, registry and log rows against their references, and references that lack their payload.

        With ``repair`` strays and orphan references go, and dangling rows are deleted. Missing payloads can't be made.
        """
        strays = [*self.store.strays(POOLS), *(f"staging/{n}" for n in self.store.names("staging"))]
        state = {r["key"]: r["state"] for r in self._registry_state().filter("state <> 'ok'").collect()}  # one row a snapshot
        logs = {r["key"]: r["state"] for r in self._log_state().filter("state <> 'ok'").collect()}
        low = sum(
            integrity.under_referenced(pool.ref_counts(refs, "content_hash").withColumn("ref_count", F.lit(1)), self.table(name).select("content_hash", F.lit(1).alias("ref_count")), "content_hash").count()
            for name, refs in (("pool_chunks", self._live("chunk_refs")), ("pool_files", self._live("file_refs").withColumnRenamed("sha256", "content_hash")))
        )
        by = lambda states, kind: sorted(k for k, v in states.items() if v == kind)
        out = {
            "strays": len(strays), "dangling": len(by(state, "dangling")), "orphan": len(by(state, "orphan")), "dangling_logs": len(by(logs, "dangling")), "orphan_logs": len(by(logs, "orphan")), "missing": low,
        }
        if repair:
            for s in strays:
                self.store.remove(s)
            for refs_id in by(state, "orphan"):
                self.store.remove_folder("chunk_refs", refs_id)
                self.store.remove_folder("file_refs", refs_id)
            for lid in by(logs, "orphan"):
                self.store.remove_folder("log_refs", lid)
            if by(state, "dangling"):
                self._amend(self.registry().filter(F.col("refs_id").isin(by(state, "dangling"))).withColumn("state", F.lit("deleted")))
            for lid in by(logs, "dangling"):
                self.delete_logs(lid)
        return out | {"total_issues": sum(out.values())}

    def summary(self) -> dict[str, int]:
        """Rows of each kind, and the bytes of everything but the pools."""
        logs = registry.current(self.table("log_snapshots"), "log_snapshot_id")
        fs, _ = self.store.path("")
        meta = sum(fs.getContentSummary(self.store.path(n)[1]).getLength() for n in (*SCHEMAS, "pointers") if self.store.exists(n))
        return {"snapshots": self.registry().count(), "log_snapshots": logs.count(), "chunks": self.table("pool_chunks").count(), "files": self.table("pool_files").count(), "logs": self.table("pool_logs").count(), "metadata_bytes": meta}

    # Logs

    def add_logs(self, tree: DataFrame, label: str | None, timestamp_ms: int, source_path: str | None = None) -> str:
        """A log snapshot of tree's files in logs/ and crash-reports/ below each top folder (the server)."""
        lid = uuid.uuid4().hex
        inner = F.expr("substring(rel, length(substring_index(rel, '/', 1)) + 2)")
        files = tree.select(F.substring_index("rel", "/", 1).alias("server"), inner.alias("path"), "size", "content").filter(P.under_any(F.col("path"), ["logs", "crash-reports"]))
        files = files.withColumn("sha256", F.unhex(F.sha2("content", 256))).withColumn("mtime_ms", F.lit(timestamp_ms))
        self.store.append("log_refs", files.withColumn("log_snapshot_id", F.lit(lid)))
        n_new = self.store.put("pool_logs", files.select(F.col("sha256").alias("content_hash"), F.col("content").alias("blob")))
        n, servers = self.table("log_refs").filter(F.col("log_snapshot_id") == lid).agg(F.count("*"), F.count_distinct("server")).first()
        self.store.append("log_snapshots", self.spark.createDataFrame([(lid, label, timestamp_ms, source_path, servers, n, n_new, "committed", time.time_ns())], SCHEMAS["log_snapshots"]))
        return lid

    def logs(self) -> DataFrame:
        """Log snapshots, newest first."""
        return registry.newest_first(registry.current(self.table("log_snapshots"), "log_snapshot_id"), "timestamp_ms", "log_snapshot_id")

    def resolve_logs(self, name: str) -> str | None:
        return registry.find(registry.current(self.table("log_snapshots"), "log_snapshot_id"), name, "log_snapshot_id", "label", "timestamp_ms")

    def delete_logs(self, lid: str) -> None:
        row = registry.current(self.table("log_snapshots"), "log_snapshot_id").filter(F.col("log_snapshot_id") == lid)
        row = row.withColumn("state", F.lit("deleted")).withColumn("seq", F.lit(time.time_ns()))
        self.store.append("log_snapshots", self.spark.createDataFrame(row.collect(), row.schema))

    def log_files(self, lid: str, server: str | None = None) -> DataFrame:
        """(target, content) of a log snapshot's files, or one server's. Missing payloads fail."""
        rows = self.table("log_refs").filter(F.col("log_snapshot_id") == lid)
        rows = rows if server is None else rows.filter(F.col("server") == server)
        target = F.concat_ws("/", "server", "path")
        return rows.join(self.table("pool_logs"), F.col("sha256") == F.col("content_hash"), "left").select(target.alias("target"), F.when(F.col("blob").isNull(), F.raise_error(F.concat(F.lit("missing log "), target))).otherwise(F.col("blob")).alias("content"))

    def extract_logs(self, lid: str, dest: str, server: str | None = None) -> int:
        files = self.log_files(lid, server).withColumnRenamed("target", "rel")
        write_files(files, dest)
        return files.count()

    def log_manifest(self, lid: str) -> str:
        """The log snapshot as JSON: servers with their files in order, keys sorted. Its size is that of one manifest."""
        row = registry.current(self.table("log_snapshots"), "log_snapshot_id").filter(F.col("log_snapshot_id") == lid).first()
        servers: dict[str, list] = {}
        for r in self.table("log_refs").filter(F.col("log_snapshot_id") == lid).orderBy("server", "path").toLocalIterator():
            servers.setdefault(r["server"], []).append({"path": r["path"], "sha256": bytes(r["sha256"]).hex(), "size": r["size"], "mtime_ms": r["mtime_ms"]})
        return json.dumps({"id": lid, "label": row["label"], "timestamp_ms": row["timestamp_ms"], "source_path": row["source_path"], "servers": servers}, indent=2, sort_keys=True)

    # Pictures

    def tiles(self, sid: str, colours: dict) -> DataFrame:
        """(content_hash, mode, rgb): a tile of each distinct payload in each mode its dimensions call for; null if unreadable. Stored ones aren't made again."""
        wanted = self._wanted_tiles(sid).join(self.table("tiles").select("content_hash", "mode"), ["content_hash", "mode"], "left_anti")
        blobs = wanted.join(self.table("pool_chunks"), "content_hash")
        raw = blobs.select("content_hash", "mode", B.decompress(_scheme("blob"), F.expr("substring(blob, 2)")).alias("raw"))
        out = [raw.filter(F.col("mode") == m).select("content_hash", "mode", B.render_tile("raw", colours, m).alias("rgb")) for m in ("topdown", "nether-floor", "nether-roof")]
        return out[0].unionByName(out[1]).unionByName(out[2])

    def _wanted_tiles(self, sid: str) -> DataFrame:
        return self.cells_of(sid).select("content_hash", F.explode(P.render_modes(F.col("dimension_key"))).alias("mode")).distinct()

    def ensure_tiles(self, sid: str, colours: dict) -> dict[str, int]:
        """Makes and stores the tiles of a snapshot that are lacking; unreadable payloads are counted and tried again next time."""
        wanted = self._wanted_tiles(sid)
        before = wanted.join(self.table("tiles").select("content_hash", "mode"), ["content_hash", "mode"], "left_semi").count()
        self.store.append("tiles", self.tiles(sid, colours).filter(F.length("rgb") == 768))
        after = wanted.join(self.table("tiles").select("content_hash", "mode"), ["content_hash", "mode"], "left_semi").count()
        return {"already": before, "made": after - before, "failed": wanted.count() - after}

    def make_sidecars(self, sid: str, side: int = 256) -> list[str]:
        """Stores pictures of the snapshot's dimensions in each of their modes, from stored tiles, in sheets of ``side`` cells; returns their names."""
        places = self.cells_of(sid).select("dimension_key", P.world_coord(F.col("rx"), F.col("cx")).alias("wx"), P.world_coord(F.col("rz"), F.col("cz")).alias("wz"), "content_hash", F.explode(P.render_modes(F.col("dimension_key"))).alias("mode"))
        rows = places.join(self.table("tiles").dropDuplicates(["content_hash", "mode"]), ["content_hash", "mode"], "left")
        self.store.remove_folder("sidecars", sid)
        self.store.append("sidecars", pictures.sheets(rows, side).withColumn("snapshot_id", F.lit(sid)))
        return sorted(r[0] for r in self.table("sidecars").filter(F.col("snapshot_id") == sid).select("name").collect())

    def write_sidecars(self, sid: str, dest: str) -> None:
        write_files(self.table("sidecars").filter(F.col("snapshot_id") == sid).select(F.col("name").alias("rel"), F.col("png").alias("content")), dest)

    def playback(self) -> DataFrame:
        """(timestamp_ms, json): each snapshot with its pictures, newest first."""
        has = self.table("sidecars").groupBy("snapshot_id").agg(F.sort_array(F.collect_list(F.struct(F.col("name").alias("filename"), F.regexp_replace("name", r"\.png$", "").alias("dim_mode"), F.array("width", "height").alias("size_px")))).alias("sidecars"))
        rows = self.registry().join(has, "snapshot_id", "left")
        entry = F.struct(F.col("snapshot_id").alias("id"), P.short_id(F.col("snapshot_id")).alias("short_id"), "label", F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), "world_name", "mc_version", "sidecars")
        return registry.newest_first(rows, "timestamp_ms", "snapshot_id").select("timestamp_ms", F.to_json(entry).alias("json"))


def write_files(files: DataFrame, dest: str) -> None:
    """Writes (rel, content) below a folder that all executors see at one path. A path that climbs out fails."""

    def write(rows):
        import os

        root = os.path.realpath(dest)
        for r in rows:
            target = os.path.realpath(os.path.join(root, r["rel"]))
            if not target.startswith(root + os.sep):
                raise ValueError(f"{r['rel']} climbs out of {dest}")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(f"{target}.tmp.{os.getpid()}", "wb") as f:
                f.write(r["content"])
            os.replace(f.name, target)

    files.select("rel", "content").foreachPartition(write)
