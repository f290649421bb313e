"""Trees, snapshots and their upkeep, on small generated worlds."""

import gzip
import io
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from stratum.codecs import nbt, raster, region
from stratum.functions import text as T
from stratum.operators import archives, compare, diff
from stratum.plans import ingest as I
from stratum.plans import pictures
from stratum.plans.places import Places
from stratum.plans.vault import Collision, LiveWorld, NoWorld, RoundTripFailed, Vault, write_files
from stratum.sources import trees

NOON = 1_700_000_000_000
#: Plans here are many and rows few: compiling them would take most of the time.
QUICK = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}


@pytest.fixture(scope="module", autouse=True)
def quick(spark):
    before = {k: spark.conf.get(k, None) for k in QUICK}
    for k, v in QUICK.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def level(played, name="1.20.4", number=3700):
    version = nbt.Tag(nbt.COMPOUND, {"Name": nbt.Tag(nbt.STRING, name), "Id": nbt.Tag(nbt.INT, number)})
    data = {"Version": version} | ({"LastPlayed": nbt.Tag(nbt.LONG, played)} if played else {})
    return gzip.compress(nbt.build(nbt.Tag(nbt.COMPOUND, {"Data": nbt.Tag(nbt.COMPOUND, data)})), mtime=0)


def put(root, rel, data):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def cells(**at):
    return region.pack([(int(k[1:].split("_")[0]), int(k.split("_")[1]), 1, 2, v) for k, v in at.items()])


def world(root, data, played=NOON):
    put(root, "region/r.0.0.mca", data)
    put(root, "level.dat", level(played))
    put(root, "session.lock", b"")
    put(root, "logs/latest.log", b"hello")
    return str(root)


def changes(v, a, b):
    return {(r["wx"], r["wz"]): r["kind"] for r in v.diff(a, b).collect()}


@pytest.fixture(scope="module")
def five(spark, tmp_path_factory):
    """A vault with five states of one world: a change, the change back, a cell more, a cell less."""
    root = tmp_path_factory.mktemp("five")
    v = Vault(spark, str(root / "vault"))
    base = {"c0_0": b"a", "c5_7": b"b", "c3_0": b"a", "c1_1": b"c"}
    states = [base, base | {"c0_0": b"A"}, base, base | {"c10_10": b"d"}, {k: x for k, x in base.items() if k != "c3_0"} | {"c10_10": b"d"}]
    ids, sizes = [], []
    for i, s in enumerate(states):
        ids.append(v.snapshot(world(root / "w", cells(**s), NOON + 1000 * i), f"s{i}", verify_roundtrip=i == 0))
        sizes.append(v.table("pool_chunks").count())
    return v, ids, sizes, root


def test_five_states(five):
    v, ids, sizes, root = five
    assert sizes == [3, 4, 4, 5, 5]  # two of the first four cells are equal
    rows = {r["snapshot_id"]: r for r in v.snapshots().collect()}
    assert [r["snapshot_id"] for r in v.snapshots().collect()] == ids[::-1] and v.snapshots(2).count() == 2
    assert [rows[i]["new_chunk_count"] for i in ids] == [3, 1, 0, 1, 0] and [rows[i]["chunk_count"] for i in ids] == [4, 4, 4, 5, 4]
    assert rows[ids[0]]["timestamp_ms"] == NOON and (rows[ids[0]]["mc_version"], rows[ids[0]]["data_version"], rows[ids[0]]["region_count"], rows[ids[0]]["file_count"]) == ("1.20.4", 3700, 1, 1)
    assert changes(v, ids[0], ids[1]) == {(0, 0): "modified"} and changes(v, ids[0], ids[2]) == {}
    assert changes(v, ids[2], ids[3]) == {(10, 10): "added"} and changes(v, ids[3], ids[4]) == {(3, 0): "removed"}
    assert v.resolve("s1") == ids[1] and v.resolve(ids[2]) == ids[2] and v.resolve(ids[2][:9].upper()) == ids[2] and v.latest("world") == ids[4] and v.resolve("no") is None
    assert v.cache_size() == {"regions": 4, "cells": 17}  # the third state is the first again
    assert v.verify() == {"ok_chunks": 5, "corrupt_chunks": 0, "ok_files": 5, "corrupt_files": 0, "ok_logs": 0, "corrupt_logs": 0, "missing_referenced": 0, "missing_files": 0, "orphan_chunks": 0, "orphan_files": 0, "missing_manifests": 0}
    assert v.fsck()["total_issues"] == 0
    s = v.summary()
    assert (s["snapshots"], s["chunks"], s["files"], s["logs"]) == (5, 5, 5, 0) and s["metadata_bytes"] > 0


def test_only_the_asked_snapshots_are_read(five):
    v, ids, _, _ = five
    plan = v.cells_of(ids[1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(refs_id" in plan


def test_unchanged_regions_are_not_parsed(five):
    v, ids, _, root = five
    tree = trees.read_tree(v.spark, world(root / "again", cells(c0_0=b"a", c5_7=b"b", c3_0=b"a", c1_1=b"c")))
    named = trees.region_files(tree).withColumn("region_sha", F.unhex(F.sha2("content", 256)))
    assert v._complete(v._cache().join(named.select("region_sha"), "region_sha", "left_semi")).count() == 1
    sid = v.snapshot(tree, "again", verify_roundtrip=False)
    assert changes(v, ids[0], sid) == {} and v.cells_of(sid).count() == 4
    v.delete(sid)


def test_restore(five, spark, tmp_path):
    v, ids, _, _ = five
    v.restore(ids[4], str(tmp_path / "out"))
    found, error = region.scan((tmp_path / "out/region/r.0.0.mca").read_bytes())
    assert error is None and {(c[0], c[1]): c[4] for c in found} == {(0, 0): b"a", (5, 7): b"b", (1, 1): b"c", (10, 10): b"d"}
    assert (tmp_path / "out/level.dat").read_bytes() == level(NOON + 4000) == v.read_file(ids[4], "level.dat") and v.read_file(ids[4], "none") is None
    v.restore(ids[4], str(tmp_path / "some"), ["level.dat"])
    assert os.listdir(tmp_path / "some") == ["level.dat"]
    assert [r["relative_path"] for r in v.stream_files(ids[0], "lev", ".dat").collect()] == ["level.dat"]
    with pytest.raises(Exception, match="climbs out"):
        write_files(spark.createDataFrame([("../evil", b"x")], "rel string, content binary"), str(tmp_path / "some"))
    assert not (tmp_path / "evil").exists()


def test_roundtrip_looks_at_regions_cells_and_files(five, tmp_path):
    v, ids, _, _ = five
    w = world(tmp_path / "w", cells(c0_0=b"A", c5_7=b"b", c9_9=b"n"), NOON)
    put(w, "data/map.dat", b"x")
    put(w, "region/r.5.5.mca", cells(c0_0=b"q"))
    out = v.roundtrip(ids[0], w)
    assert not out.passed() and {(r["cx"], r["cz"]): r["status"] for r in out.cells.collect()} == {(0, 0): "hash_mismatch", (9, 9): "missing_in_restore", (3, 0): "extra_in_restore", (1, 1): "extra_in_restore"}
    assert {r["relative_path"]: r["status"] for r in out.files.collect()} == {"level.dat": "equal", "data/map.dat": "missing_in_restore", "logs/latest.log": "excluded"}
    assert out.counts() == {"cells_checked": 2, "cells_matching": 1, "cell_mismatches": 4, "files_checked": 1, "files_matching": 1, "file_mismatches": 1, "missing_regions": 1, "extra_regions": 0, "excluded": 1, "errors": 0}
    text = out.report("here", "there")
    assert text.startswith("left: here\nright: there\nFAIL") and "missing_in_restore" in text and "## regions (1)" in text


def test_two_folders(spark, tmp_path):
    a, b = world(tmp_path / "a", cells(c0_0=b"a")), world(tmp_path / "b", cells(c0_0=b"a"))
    put(b, "region/r.1.0.mca", b"broken")
    same = compare.compare_trees(trees.read_tree(spark, a), trees.read_tree(spark, a))
    assert same.passed() and same.counts()["files_matching"] == 2  # Spark's file source doesn't list empty files
    out = compare.compare_trees(trees.read_tree(spark, a), trees.read_tree(spark, b), ["logs/**"])
    assert not out.passed() and out.counts()["extra_regions"] == 1 and out.counts()["errors"] == 1
    put(b, "level.dat", level(5))
    assert compare.compare_trees(trees.read_tree(spark, a), trees.read_tree(spark, b)).counts()["file_mismatches"] == 1


def test_worlds_that_are_refused(spark, tmp_path):
    v = Vault(spark, str(tmp_path / "vault"))
    put(tmp_path / "x", "readme.txt", b"no world")
    with pytest.raises(NoWorld):
        v.snapshot(str(tmp_path / "x"))
    w = world(tmp_path / "w", cells(c0_0=b"a"))
    with pytest.raises(LiveWorld):
        v.snapshot(trees.read_tree(spark, w, mounted=True), allow_live=False)
    put(w, "region/r.0.0.mcr", cells(c0_0=b"b"))
    with pytest.raises(ValueError, match="same coordinates"):
        v.snapshot(w)
    os.remove(f"{w}/region/r.0.0.mcr")
    put(w, "region/r.7.7.mca", b"torn")
    with pytest.raises(RoundTripFailed):
        v.snapshot(w)
    assert v.snapshots().count() == 0 and v.table("chunk_refs").count() == 0
    sid = v.snapshot(w, verify_roundtrip=False)
    assert v.cells_of(sid).count() == 1 and [r["rel"] for r in v.table("errors").filter(F.col("snapshot_id") == sid).collect()] == ["region/r.7.7.mca"]


def test_times_and_labels(spark, tmp_path):
    v = Vault(spark, str(tmp_path / "vault"))
    w = world(tmp_path / "w", cells(c0_0=b"a"))
    one, two = (v.snapshot(w, f"world-2023-11-14-22-13-2{i}", timestamp_ms=NOON + 1000 * i, verify_roundtrip=False) for i in (0, 1))
    with pytest.raises(Collision):
        v.retime(two, NOON)
    v.retime(two, NOON + 5000)
    v.retime(two, NOON + 6000)
    row = v.snapshots().first()
    assert (row["label"], row["original_timestamp_ms"], row["timestamp_ms"]) == ("world-2023-11-14-22-13-26", NOON + 1000, NOON + 6000)
    assert v.retime_many({one: NOON + 7000, two: NOON + 7000}) == sorted([one, two])  # they would meet
    v.rename(one, "mine")
    assert v.retime_many({one: NOON + 7000, two: NOON + 7000}) == []
    assert v.backup_registry().endswith("snapshots.bak") and v.spark.read.parquet(f"{v.store.root}/snapshots.bak").count() == v.table("snapshots").count()


def test_repairing_times(spark, tmp_path):
    v = Vault(spark, str(tmp_path / "vault"))
    w = world(tmp_path / "w", cells(c0_0=b"a"))
    right = v.snapshot(w, "x", "w1", verify_roundtrip=False)
    wrong = v.snapshot(w, "w1-2023-11-15-00-00-00", "w1", 1_700_006_400_000, verify_roundtrip=False)  # the same world and time: goes
    alone = v.snapshot(w, "w2-2023-11-15-00-00-00", "w2", 1_700_006_400_000, verify_roundtrip=False)
    v._change(alone, last_played_ms=None)  # known only from its level.dat
    world(tmp_path / "w", cells(c0_0=b"a"), None)
    unknown = v.snapshot(w, "z", "w3", 5, verify_roundtrip=False)
    want = {"scanned": 4, "to_delete": 1, "to_retime": 1, "already_correct": 1, "no_last_played": 1, "recovered": 1}
    assert v.repair_timestamps() == want and v.snapshots().count() == 4
    assert v.repair_timestamps(dry_run=False) == want
    rows = {r["snapshot_id"]: r for r in v.snapshots().collect()}
    assert set(rows) == {right, alone, unknown} and wrong not in rows
    assert (rows[alone]["timestamp_ms"], rows[alone]["last_played_ms"], rows[alone]["original_timestamp_ms"], rows[alone]["label"]) == (NOON, NOON, 1_700_006_400_000, "w2-2023-11-14-22-13-20")
    assert v.repair_timestamps() == {"scanned": 3, "to_delete": 0, "to_retime": 0, "already_correct": 2, "no_last_played": 1, "recovered": 0}


def test_collection_and_repair(spark, tmp_path):
    v = Vault(spark, str(tmp_path / "vault"))
    w = world(tmp_path / "w", cells(c0_0=b"a", c1_0=b"b"))
    one = v.snapshot(w, "one", verify_roundtrip=False)
    two = v.snapshot(world(tmp_path / "w", cells(c0_0=b"a", c2_0=b"c"), NOON + 1), "two", verify_roundtrip=False)
    v.delete(one)
    assert v.resolve("one") is None and v.fsck()["total_issues"] == 0
    folders = set(v.store.names("pool_chunks"))
    assert v.gc() == {"pool_chunks": 1, "pool_files": 1, "pool_logs": 0} and v.gc() == {"pool_chunks": 0, "pool_files": 0, "pool_logs": 0}
    assert folders <= set(v.store.names("pool_chunks")) and v.table("chunk_refs").select("refs_id").distinct().count() == 1
    assert v.verify()["missing_referenced"] == 0 and v.roundtrip(two, w).passed()

    # What interrupted writes leave: pool folders without a pointer, and references without a registry row.
    put(v.store.root, "pool_chunks/dead/part=00/x.parquet", b"")
    v.store.append("chunk_refs", v.cells_of(two).withColumn("refs_id", F.lit("lost")))
    v.store.remove_folder("file_refs", two)
    v.store.remove_folder("chunk_refs", two)
    assert v.fsck(repair=True) == {"strays": 2, "dangling": 1, "orphan": 1, "dangling_logs": 0, "orphan_logs": 0, "missing": 0, "total_issues": 4}
    assert v.fsck()["total_issues"] == 0 and v.snapshots().count() == 0

    three = v.snapshot(w, "three", verify_roundtrip=False)
    blob = v.table("pool_chunks").first()
    bad = spark.createDataFrame([(bytes(blob["content_hash"]), b"\x02tampered")], "content_hash binary, blob binary")
    v.store.drop("pool_chunks", bad.select("content_hash"))
    v.store.put("pool_chunks", bad)
    assert v.verify()["corrupt_chunks"] == 1 and v.verify(repair=True)["corrupt_chunks"] == 1
    assert v.verify()["missing_referenced"] == 1 and v.fsck()["missing"] == 1
    v.snapshot(w, "four", verify_roundtrip=False)  # the cache doesn't vouch for what the pool has lost
    assert v.verify()["missing_referenced"] == 0 and v.roundtrip(three, w).passed()


def test_external_payload_is_the_same_cell(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    put(a, "region/r.-1.2.mca", region.pack([(31, 31, 1, 2, b"same")]))
    put(b, "region/r.-1.2.mca", region.pack([(31, 31, 9, 0x82, b"")]))
    put(b, "region/c.-1.95.mcc", b"same")
    (x,), (y,) = (trees.cells(trees.read_tree(spark, str(p)))[0].collect() for p in (a, b))
    assert x["content_hash"] == y["content_hash"] and (x["wx"], x["wz"]) == (-1, 95)
    assert trees.cell(trees.read_tree(spark, str(b)), "region", -1, 95).first()["payload"] == b"same" and trees.cell(trees.read_tree(spark, str(b)), "region", 3, 3).count() == 0
    v = Vault(spark, str(tmp_path / "vault"))
    one, two = v.snapshot(str(a), "a", verify_roundtrip=False), v.snapshot(str(b), "b")
    assert changes(v, one, two) == {} and v.table("pool_chunks").count() == 1 and v.cache_size()["regions"] == 1
    v.restore(two, str(tmp_path / "out"))
    assert (tmp_path / "out/region/c.-1.95.mcc").read_bytes() == b"same"
    assert v.backfill_cache(str(b), two) == {"added": 0, "missing": 0, "external": 1, "already": 0} and v.backfill_cache(str(a), one)["already"] == 1


def test_backfilling_the_cache(spark, tmp_path):
    v = Vault(spark, str(tmp_path / "vault"))
    w = world(tmp_path / "w", cells(c0_0=b"a", c4_4=b"b"))
    sid = v.snapshot(w, "one", verify_roundtrip=False)
    before = v._cache().collect()
    v.store.remove("region_cache")
    put(w, "region/r.9.9.mca", cells(c0_0=b"z"))
    assert v.backfill_cache(w, sid) == {"added": 1, "missing": 1, "external": 0, "already": 0}
    assert sorted(before[0]["cells"]) == sorted(v._cache().collect()[0]["cells"]) and before[0]["region_sha"] == v._cache().collect()[0]["region_sha"]


def test_whole_files_and_their_migration(spark, tmp_path):
    v = Vault(spark, str(tmp_path / "vault"))
    w = world(tmp_path / "w", cells(c0_0=b"a", c1_0=b"b"))
    put(w, "region/r.3.3.mca", cells(c0_0=b"k"))
    one = v.snapshot(w, "one", whole_files=True, verify_roundtrip=False)
    world(tmp_path / "w", cells(c0_0=b"a", c1_0=b"B"))
    two = v.snapshot(w, "two", whole_files=True, verify_roundtrip=False)
    assert v.cells_of(one).count() == 0 and {r["relative_path"] for r in v.diff_files(one, two).collect()} == {"region/r.0.0.mca"}
    assert [(r["wx"], r["wz"], r["kind"]) for r in v.diff_whole_files(one, two).collect()] == [(1, 0, "modified")]
    assert v.migrate() == {"snapshots": 2, "files": 4, "migrated": 0, "missing": 0, "unreadable": 0, "external": 0} and v.cells_of(one).count() == 0
    assert v.migrate(dry_run=False)["migrated"] == 4
    assert changes(v, one, two) == {(1, 0): "modified"} and v.files_of(one).count() == 1
    rows = {r["snapshot_id"]: r for r in v.snapshots().collect()}
    assert (rows[one]["chunk_count"], rows[one]["region_count"], rows[one]["file_count"]) == (3, 2, 1)
    assert v.migrate()["files"] == 0 and v.fsck()["total_issues"] == 0
    v.gc()
    assert v.roundtrip(two, w).passed() and v.table("pool_files").count() == 1


def test_discovery_and_broken_regions(spark, tmp_path):
    good = cells(c0_0=b"x")
    for rel in ("w/region/r.0.0.mca", "w/DIM-1/region/r.0.0.mca", "w/region/deeper/r.1.1.mca", "a/b/c/d/e/f/r.0.0.mca"):
        put(tmp_path, rel, good)
    put(tmp_path, "w/region/r.5.5.mca", b"short")
    tree = trees.read_tree(spark, str(tmp_path))
    assert {r["dimension_key"] for r in trees.region_files(tree).collect()} == {"w/region", "w/DIM-1/region"}
    found, errors = trees.cells(tree)
    assert found.count() == 2 and [r["rel"] for r in errors.collect()] == ["w/region/r.5.5.mca"]
    assert {(r["server"], r["regions"]) for r in trees.servers(trees.region_files(tree)).collect()} == {("w", 3)}


def test_walking_finds_hidden_files(spark, tmp_path):
    for rel in (".hidden", "_under/x", "a/b.txt"):
        put(tmp_path / "t", rel, rel.encode())
    put(tmp_path / "t", "empty", b"")
    assert {r["rel"] for r in trees.read_tree(spark, str(tmp_path / "t")).collect()} == {"a/b.txt"}
    assert {(r["rel"], bytes(r["content"])) for r in trees.read_tree(spark, str(tmp_path / "t"), mounted=True).collect()} == {(x, x.encode()) for x in (".hidden", "_under/x", "a/b.txt")} | {("empty", b"")}


@pytest.mark.parametrize(
    "regions, levels, want",
    [
        (["s/world/region", "s/world/DIM-1/region"], ["s/world"], [("s", "s", "s/world")]),
        (["s/world/region", "s/world_nether/DIM-1/region"], [], [("s", "s", "s")]),
        (["s/world/region", "s/world/dimensions/x/y/region"], ["s/world"], [("s", "s", "s/world")]),
        (["s/survival/region"], [], [("s", "s", "s/survival")]),
        (["a/w/region", "b/w/region"], ["b"], [("a", "a", "a/w"), ("b", "b", "b")]),
        (["region"], ["."], [("zip", ".", ".")]),
    ],
)
def test_servers_and_their_worlds(spark, regions, levels, want):
    r = spark.createDataFrame([(x,) for x in regions], "dimension_key string")
    f = spark.createDataFrame([("level.dat" if x == "." else f"{x}/level.dat",) for x in levels], "rel string")
    got = sorted(tuple(x) for x in archives.discover_servers(f, r, "zip").collect())
    if regions == ["region"]:  # a top folder with regions is a server by itself
        assert got == [("region", "region", "region")] or got == want
    else:
        assert got == want


def server(put_, name, played, cell=b"x"):
    put_(f"{name}/world/level.dat", level(played))
    put_(f"{name}/world/region/r.0.0.mca", cells(c0_0=cell))
    put_(f"{name}/logs/latest.log", b"log of " + name.encode())
    put_(f"{name}/crash-reports/crash.txt", b"same crash")
    put_(f"{name}/server.properties", b"no")


@pytest.mark.parametrize("kind", ["tar.gz", "folder"])
def test_ingest(spark, tmp_path, kind):
    files = {}
    server(files.__setitem__, "EX-Server", NOON)
    server(files.__setitem__, "CR-Server", NOON + 60_000, b"y")
    server(files.__setitem__, "No-Time", None)
    path = str(tmp_path / "in" / ("2025-04-25-12-34-56" + {"zip": ".zip", "tar.gz": ".tar.gz", "folder": ""}[kind]))
    os.makedirs(os.path.dirname(path))
    if kind == "zip":
        with zipfile.ZipFile(path, "w") as z:
            for n, d in files.items():
                z.writestr(n, d)
    elif kind == "tar.gz":
        with tarfile.open(path, "w:gz") as t:
            for n, d in files.items():
                info = tarfile.TarInfo(n)
                info.size = len(d)
                t.addfile(info, io.BytesIO(d))
    else:
        for n, d in files.items():
            put(path, n, d)
    assert I.servers_of(spark, path) == ["CR-Server", "EX-Server", "No-Time"]
    v = Vault(spark, str(tmp_path / "vault"))
    out = I.ingest_archive(v, path, verify_roundtrip=False)
    assert set(out.snapshots) == {"EX-Server", "CR-Server"} and out.skipped == {"No-Time": I.NO_TIME} and out.label == "2023-11-14-22-14-20"
    rows = {r["label"]: r for r in v.snapshots().collect()}
    assert set(rows) == {"EX-Server-2023-11-14-22-13-20", "CR-Server-2023-11-14-22-14-20"} and rows["EX-Server-2023-11-14-22-13-20"]["world_name"] == "EX-Server"
    assert {r["relative_path"] for r in v.files_of(out.snapshots["EX-Server"]).collect()} == {"level.dat"}
    logs = v.logs().collect()
    assert [(r["label"], r["server_count"], r["file_count"], r["new_file_count"]) for r in logs] == [("2023-11-14-22-14-20", 2, 4, 3)]
    assert v.extract_logs(out.logs, str(tmp_path / "logs"), "EX-Server") == 2 and (tmp_path / "logs/EX-Server/logs/latest.log").read_bytes() == b"log of EX-Server"
    again = I.ingest_archive(v, path)
    assert set(again.already) == {"EX-Server", "CR-Server"} and not again.snapshots and v.snapshots().count() == 2 and v.logs().count() == 1
    if kind == "folder":
        assert I.ingest_archive(v, path, server="nobody").snapshots == {} and set(I.ingest_archive(v, path, NOON + 9_000_000, server="No-Time", verify_roundtrip=False).snapshots) == {"No-Time"}
        manifest = json.loads(v.log_manifest(out.logs))
        assert list(manifest["servers"]) == ["CR-Server", "EX-Server"] and manifest["servers"]["EX-Server"][0]["path"] == "crash-reports/crash.txt"
        assert v.resolve_logs(out.label) == out.logs
        v.delete_logs(out.logs)
        assert v.logs().count() == 1 and v.resolve_logs(out.label) is None and v.gc()["pool_logs"] == 2 and v.fsck()["total_issues"] == 0
    assert v.store.names("staging") == []


def test_ingest_into_many_vaults_and_import(spark, tmp_path):
    server(lambda rel, d: put(tmp_path / "in", rel, d), "A", NOON)
    server(lambda rel, d: put(tmp_path / "in", rel, d), "B", NOON)
    vaults = {n: Vault(spark, str(tmp_path / f"vault{n}")) for n in "A"}
    out = I.ingest_into_vaults(vaults["A"], str(tmp_path / "in"), vaults.get, verify_roundtrip=False)
    assert set(out) == {"A"} and vaults["A"].snapshots().count() == 1 and vaults["A"].logs().count() == 1
    sid = I.import_world(vaults["A"], str(tmp_path / "in" / "B"), verify_roundtrip=False)
    assert vaults["A"].resolve("B") == sid and {r["relative_path"] for r in vaults["A"].files_of(sid).collect()} == {"level.dat"}
    put(tmp_path / "none", "x/y/z/level.dat", level(1))
    with pytest.raises(I.NoServers):
        I.import_world(vaults["A"], str(tmp_path / "none"))
    with pytest.raises(I.NoServers):
        I.ingest_archive(vaults["A"], str(tmp_path / "none"))


def test_archives(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i in range(3000):
            z.writestr(f"s1/logs/{i}.log", b"one")
    put(tmp_path, "in/2024-01-02-03-04-05.zip", data.getvalue())
    for mounted in (False, True):
        assert trees.archive_entries(spark, str(tmp_path / "in"), content=True, mounted=mounted).agg(F.count("*"), F.sum("size"), F.count("content")).first()[:] == (3000, 9000, 3000)
    assert trees.archives(spark, str(tmp_path / "in")).count() == 1
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../x", b"")
    put(tmp_path, "bad/a.zip", evil.getvalue())
    with pytest.raises(Exception, match="climbs out"):
        trees.archive_entries(spark, str(tmp_path / "bad")).collect()
    files = spark.createDataFrame([("a.zip", 5), ("x/b.TAR.GZ", 7), ("x/y/z/c.zip", 9), ("x/y/z/w/d.zip", 11), ("node_modules/e.zip", 13), ("f.txt", 1)], "rel string, size long")
    assert archives.archive_scan(files, samples=2).collect() == [(3, 21, ["a.zip", "b.TAR.GZ"])] and archives.archive_scan(files.filter("rel = 'f.txt'")).count() == 0


def test_pictures_and_exchange(five, spark, tmp_path):
    v, ids, _, _ = five
    d = v.diff(ids[0], ids[3])
    pictures.write_diff_json(d, str(tmp_path / "d.json"), {"snap_a": ids[0]})
    got = json.loads((tmp_path / "d.json").read_text())
    assert got["summary"] == {"added": 1, "removed": 0, "modified": 0} and got["total"] == 1 and got["changes"][0]["old_hash"] is None and len(got["changes"][0]["new_hash"]) == 32 and got["changes"][0]["cx"] == 10
    page = pictures.map_page("<x>", d, v.version_change(ids[0], ids[3]))
    assert "&lt;x&gt;" in page and "canvas" in page and '"version_changed": false' in page
    many = spark.createDataFrame([("region", x, z, "added") for x, z in ((0, 0), (700, 3))], "dimension_key string, wx int, wz int, kind string")
    sheets = {r["name"]: r["png"] for r in pictures.heat_sheets(many, side=512, scale=2).collect()}
    assert {k: raster.png_size(bytes(p)) for k, p in sheets.items()} == {"region-diff.0.0.png": (1024, 8), "region-diff.1.0.png": (378, 8)}
    assert raster.png_size(b"nothing") is None


def test_tiles_are_kept(spark, tmp_path):
    v = Vault(spark, str(tmp_path / "vault"))
    section = nbt.Tag(nbt.COMPOUND, {"Y": nbt.Tag(nbt.BYTE, 0), "block_states": nbt.Tag(nbt.COMPOUND, {"palette": nbt.Tag(nbt.LIST, [nbt.Tag(nbt.COMPOUND, {"Name": nbt.Tag(nbt.STRING, "minecraft:stone")})])})})
    chunk = nbt.build(nbt.Tag(nbt.COMPOUND, {"DataVersion": nbt.Tag(nbt.INT, 3700), "yPos": nbt.Tag(nbt.INT, 0), "sections": nbt.Tag(nbt.LIST, [section])}))
    put(tmp_path / "w", "region/r.0.0.mca", region.pack([(0, 0, 1, 3, chunk), (1, 0, 1, 3, b"no cell"), (2, 0, 1, 3, chunk)]))
    sid = v.snapshot(str(tmp_path / "w"), "one", verify_roundtrip=False)
    colours = raster.colours_of({"minecraft:stone": 11, "minecraft:air": 0})
    assert v.ensure_tiles(sid, colours) == {"already": 0, "made": 1, "failed": 1} and v.ensure_tiles(sid, colours) == {"already": 1, "made": 0, "failed": 1}
    assert bytes(v.table("tiles").first()["rgb"]) == bytes((112, 112, 112)) * 256
    assert v.make_sidecars(sid) == ["region-topdown.png"] == v.make_sidecars(sid)
    v.write_sidecars(sid, str(tmp_path / "out"))
    assert raster.png_size((tmp_path / "out/region-topdown.png").read_bytes()) == (48, 16)
    entry = json.loads(v.playback().first()["json"])
    assert entry["id"] == sid and entry["sidecars"] == [{"filename": "region-topdown.png", "dim_mode": "region-topdown", "size_px": [48, 16]}]
    v.delete(sid)
    v.gc()
    assert v.gc_tiles() == 1 and v.table("tiles").count() == 0
    assert raster.base_colour(61) == (127, 167, 150) and raster.base_colour(62) == raster.UNMAPPED and raster.is_air("minecraft:cave_air")


def test_nulls_in_differences(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (None, "n")], "k int, hash string")
    b = spark.createDataFrame([(1, None), (2, None), (None, "m"), (3, None)], "k int, hash string")
    assert {r["k"]: r["kind"] for r in diff.full_diff(a, b, ["k"]).collect()} == {2: "modified", None: "modified", 3: "added"}


def test_places(tmp_path):
    p = Places(str(tmp_path / "c.json"))
    assert p.list("repos") == [] and p.add("repos", str(tmp_path / "v"), "one") and not p.add("repos", str(tmp_path / "x/../v"), "two")
    assert p.list("repos") == [{"path": os.path.realpath(tmp_path / "v"), "label": "two"}] and p.add("source_paths", "s3://bucket/in")
    assert p.remove("repos", str(tmp_path / "v")) and not p.remove("repos", str(tmp_path / "v"))
    (tmp_path / "c.json").write_text("[broken")
    assert p.list("source_paths") == []


def test_sizes_and_times_as_text(spark):
    n = [0, 1023, 1024, 1536, 5 * 1024**3, 3000 * 1024**4]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in n], "n long").select(T.size_text(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 GB", "3000.0 TB"]
    at = spark.range(1).select(T.local_time(F.lit(NOON), "Asia/Kolkata"), T.local_time(F.lit(NOON), "America/New_York"), T.local_time(F.lit(NOON), "UTC")).first()
    assert at[:] == ("2023-11-15 03:43:20+05:30", "2023-11-14 17:13:20-05:00", "2023-11-14 22:13:20+00:00")


def test_commands(spark, tmp_path, capsys):
    from stratum.__main__ import main, parser

    w = world(tmp_path / "w", cells(c0_0=b"a"))
    vault = ["--vault", str(tmp_path / "vault")]
    main(["snapshot", w, "--label", "one", "--no-verify", *vault])
    world(tmp_path / "w", cells(c0_0=b"b"), NOON + 1000)
    main(["snapshot", w, "--label", "two", "--no-verify", *vault])
    main(["diff-snaps", "one", "two", "--json", str(tmp_path / "d.json"), "--html", str(tmp_path / "d.html"), "--png", str(tmp_path / "png"), *vault])
    assert json.loads((tmp_path / "d.json").read_text())["total"] == 1 and os.listdir(tmp_path / "png") == ["region-diff.png"]
    main(["list", *vault])
    assert '"label": "two"' in capsys.readouterr().out
    main(["diff", w, w])
    with pytest.raises(SystemExit) as e:
        main(["verify", *vault])
    assert e.value.code == 0
    with pytest.raises(SystemExit) as e:
        main(["verify-roundtrip", "one", w, *vault])
    assert e.value.code == 1
    assert {"ingest", "import", "restore", "gc", "fsck", "verify-folders", "thumbnail", "repair-timestamps", "logs-extract", "repo"} <= set(parser()._subparsers._group_actions[0].choices)
