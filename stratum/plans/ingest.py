"""Archives into vaults: one snapshot per server, one log snapshot per archive; doing it again changes nothing."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import binary as B
from stratum.functions import paths as P
from stratum.operators import archives
from stratum.plans.vault import Vault
from stratum.sources import trees

TREE = "rel string, size long, modified_ms long, content binary"
NO_TIME = "level.dat doesn't say when the world was last played; give a time"


class NoServers(ValueError):
    """No folder of the archive holds region files."""


@dataclass
class Ingested:
    """What an archive brought: ids by server, reasons by server, ids that were there before, and the log snapshot's id."""

    label: str = ""
    timestamp_ms: int | None = None
    snapshots: dict[str, str] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)
    already: dict[str, str] = field(default_factory=dict)
    logs: str | None = None


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _label(prefix: str, millis: int) -> str:
    return f"{prefix}{time.strftime('%Y-%m-%d-%H-%M-%S', time.gmtime(millis // 1000))}"


class Opened:
    """An archive's files, or a folder's, unpacked once into a table below a vault's root, and dropped at the end."""

    def __init__(self, vault: Vault, path: str, mounted: bool = False):
        self.vault, self.path, self.staging = vault, path, f"staging/{uuid.uuid4().hex}"
        self.archive = path.lower().endswith(P.ARCHIVE_SUFFIXES)
        self.mounted = mounted

    def __enter__(self) -> DataFrame:
        spark, at = self.vault.spark, f"{self.vault.store.root}/{self.staging}"
        tree = trees.archive_entries(spark, self.path, content=True, mounted=self.mounted).drop("archive") if self.archive else trees.read_tree(spark, self.path, self.mounted)
        tree.select("rel", "size", "modified_ms", "content").write.parquet(at)
        return spark.read.schema(TREE).parquet(at)

    def __exit__(self, *_):
        self.vault.store.remove(self.staging)


def _servers(tree: DataFrame, path: str) -> list:
    name = _name(path)
    for s in P.ARCHIVE_SUFFIXES[::-1]:
        name = name.removesuffix(s)
    found = archives.discover_servers(tree.select("rel"), trees.region_files(tree).select("dimension_key"), name)
    return sorted(found.collect(), key=lambda r: r["server"])  # one row a server


def _played(tree: DataFrame) -> int | None:
    """When the world was last played, by the level.dat at its root or else one folder down."""
    level = tree.filter(F.col("rel").rlike(r"^([^/]+/)?level\.dat$")).withColumn("info", B.world_info(B.decompress(F.lit(1), "content")))
    row = level.filter("info.last_played_ms > 0").orderBy(archives.depth(F.col("rel")), "rel").select("info.last_played_ms").first()
    return row[0] if row else None


def servers_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the servers in an archive or folder, from its listing."""
    if path.lower().endswith(P.ARCHIVE_SUFFIXES):
        tree = trees.archive_entries(spark, path)
    else:
        tree = trees.read_tree(spark, path).drop("content")
    return [r["server"] for r in _servers(tree, path)]


def _take(vault: Vault, tree: DataFrame, server, when: int, out: Ingested, verify_roundtrip: bool) -> bool:
    """Snapshots one server into the vault, unless its label is there; whether it is new."""
    name, world = server["server"], trees.below(tree, server["world_root"])
    label = _label(f"{name}-", when)
    there = vault.resolve(label)
    if there:
        out.already[name] = there
        vault.backfill_cache(world, there)
        return False
    try:
        out.snapshots[name] = vault.snapshot(world, label, name, when, verify_roundtrip=verify_roundtrip)
    except Exception as e:  # one server's fault must not stop the others; it is reported
        out.skipped[name] = str(e)
        return False
    return True


def _server_logs(tree: DataFrame, server) -> DataFrame:
    """The server's logs and crash reports, below a top folder of its name."""
    files = trees.below(tree, server["server_root"]).filter(P.under_any(F.col("rel"), ["logs", "crash-reports"]))
    return files.withColumn("rel", F.concat(F.lit(server["server"] + "/"), "rel"))


def _add_logs(vault: Vault, files: DataFrame, label: str, when: int, path: str) -> str | None:
    if not files.limit(1).count():
        return None
    return vault.resolve_logs(label) or vault.add_logs(files, label, when, path)


def ingest_archive(vault: Vault, path: str, timestamp_ms: int | None = None, skip_logs: bool = False, verify_roundtrip: bool = True, server: str | None = None, mounted: bool = False) -> Ingested:
    """Takes every server of an archive (or folder), or one, into the vault, and their logs as one log snapshot.

    A server's time is when its world was last played, and its label follows from that, so the same archive gives the
    same labels; a server that doesn't know its time is skipped unless ``timestamp_ms`` is given. Servers whose label
    is there aren't taken again, nor are their logs. The loop runs over an archive's servers, each of them many tasks.
    """
    with Opened(vault, path, mounted) as tree:
        found = _servers(tree, path)
        if not found:
            raise NoServers(f"{_name(path)}: no folder holds region files")
        found = [s for s in found if server is None or s["server"] == server]
        out = Ingested()
        if not found:
            return out
        times = {s["server"]: timestamp_ms or _played(trees.below(tree, s["world_root"])) for s in found}
        known = [t for t in times.values() if t]
        out.timestamp_ms = max(known) if known else vault.spark.range(1).select(P.timestamp_of_name(F.lit(_name(path)))).first()[0] or int(time.time() * 1000)
        out.label = _label("", out.timestamp_ms)
        files = tree.limit(0)
        for s in found:
            when = times[s["server"]]
            if not when:
                out.skipped[s["server"]] = NO_TIME
            elif _take(vault, tree, s, when, out, verify_roundtrip):
                files = files.unionByName(_server_logs(tree, s))
        if not skip_logs:
            out.logs = _add_logs(vault, files, out.label, out.timestamp_ms, path)
        return out


def ingest_into_vaults(home: Vault, path: str, vaults, timestamp_ms: int | None = None, skip_logs: bool = False, verify_roundtrip: bool = True, mounted: bool = False) -> dict[str, Ingested]:
    """Takes each server of an archive into the vault that ``vaults(server)`` names, or none; the archive is unpacked once, below home's root."""
    out: dict[str, Ingested] = {}
    with Opened(home, path, mounted) as tree:
        found = _servers(tree, path)
        if not found:
            raise NoServers(f"{_name(path)}: no folder holds region files")
        for s in found:
            vault = vaults(s["server"])
            when = vault and (timestamp_ms or _played(trees.below(tree, s["world_root"])))
            if not when:
                continue
            result = out[s["server"]] = Ingested(_label(f"{s['server']}-", when), when)
            if _take(vault, tree, s, when, result, verify_roundtrip) and not skip_logs:
                result.logs = _add_logs(vault, _server_logs(tree, s), _label("", when), when, path)
    return out


def import_world(vault: Vault, path: str, label: str | None = None, folder: str | None = None, mounted: bool = False, **options) -> str:
    """One snapshot of the one world in an archive or folder: the given folder, or the first with a level.dat or a region folder at most two levels down.

    The default label is the file's name without its suffix.
    """
    name = _name(path)
    with Opened(vault, path, mounted) as tree:
        at = folder
        if at is None:
            row = archives.locate_world(tree.select("rel")).first()
            if row is None:
                raise NoServers(f"{name}: no world at most two folders down")
            at = row["folder"]
        return vault.snapshot(trees.below(tree, at), label or vault.spark.range(1).select(P.without_archive_suffix(F.lit(name))).first()[0], **options)
