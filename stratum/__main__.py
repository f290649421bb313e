"""Commands: python -m stratum COMMAND ... Paths are read and written by Spark, or by all executors, at the same place."""

from __future__ import annotations

import argparse
import json
import os
import sys


def _vault(args):
    from stratum.plans.vault import Vault

    return Vault(_spark(), args.vault)


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _id(vault, name: str, logs: bool = False) -> str:
    found = vault.resolve_logs(name) if logs else vault.resolve(name)
    if found is None:
        sys.exit(f"no snapshot {name}")
    return found


def _show(x) -> None:
    print(json.dumps(x, indent=2, default=str))


def _rows(frame) -> None:
    for r in frame.toLocalIterator():
        print(json.dumps(r.asDict(), default=str))


def _changes(changes, args, title: str, names: dict, versions: dict | None = None, errors=None) -> None:
    from stratum.operators import diff
    from stratum.plans import pictures
    from stratum.plans.vault import write_files

    _show(diff.count_by_kind(changes).first().asDict())
    _rows(diff.count_by(changes, "dimension_key").orderBy("dimension_key"))
    if args.json:
        pictures.write_diff_json(changes, args.json, names, errors)
    if args.png:
        write_files(pictures.heat_sheets(changes).withColumnRenamed("name", "rel").withColumnRenamed("png", "content"), args.png)
    if args.html:
        with open(args.html, "w", encoding="utf-8") as f:
            f.write(pictures.map_page(title, changes, versions, errors.count() if errors is not None else 0, args.tiles))


def diff_trees(args) -> None:
    from pyspark.sql import functions as F

    from stratum.operators import diff
    from stratum.sources import trees

    (a, bad_a), (b, bad_b) = (trees.cells(trees.read_tree(_spark(), p)) for p in (args.old, args.new))
    # A region that only one side can't read is empty there; one that neither can isn't compared, as it has no cells.
    errors = bad_a.withColumn("side", F.lit("old")).unionByName(bad_b.withColumn("side", F.lit("new")))
    changes = diff.full_diff(a, b, ["dimension_key", "rx", "rz", "cx", "cz"], "content_hash")
    changes = changes.withColumn("wx", F.col("rx") * 32 + F.col("cx")).withColumn("wz", F.col("rz") * 32 + F.col("cz"))
    _changes(changes, args, f"{args.old} to {args.new}", {}, None, errors)


def diff_snaps(args) -> None:
    v = _vault(args)
    a, b = _id(v, args.old), _id(v, args.new)
    _changes(v.diff(a, b), args, f"{args.old} to {args.new}", {"snap_a": a, "snap_b": b}, v.version_change(a, b))


def snapshot(args) -> None:
    from stratum.functions import paths as P

    print(_vault(args).snapshot(args.world, args.label, args.world_name, args.timestamp_ms, args.exclude or P.DEFAULT_EXCLUDES, not args.no_verify, args.allow_live))


def list_(args) -> None:
    _rows(_vault(args).snapshots(args.limit).select("snapshot_id", "label", "world_name", "timestamp_ms", "chunk_count", "new_chunk_count", "file_count", "mc_version"))


def restore(args) -> None:
    v = _vault(args)
    v.restore(_id(v, args.snapshot), args.dest, args.path or None)


def delete(args) -> None:
    v = _vault(args)
    v.delete(_id(v, args.snapshot))


def gc(args) -> None:
    _show(_vault(args).gc())


def fsck(args) -> None:
    out = _vault(args).fsck(repair=args.repair)
    _show(out)
    sys.exit(1 if out["total_issues"] and not args.repair else 0)


def verify(args) -> None:
    out = _vault(args).verify(repair=args.repair)
    _show(out)
    sys.exit(1 if out["corrupt_chunks"] + out["corrupt_files"] + out["missing_referenced"] + out["missing_files"] else 0)


def ingest(args) -> None:
    from stratum.plans.ingest import ingest_archive

    for path in args.archive:
        _show(vars(ingest_archive(_vault(args), path, args.timestamp_ms, args.skip_logs, not args.no_verify, args.server)))


def import_(args) -> None:
    from stratum.plans.ingest import import_world

    print(import_world(_vault(args), args.archive, args.label, args.world_subpath))


def servers(args) -> None:
    from stratum.plans.ingest import servers_of

    _show(servers_of(_spark(), args.archive))


def verify_roundtrip(args) -> None:
    v = _vault(args)
    out = v.roundtrip(_id(v, args.snapshot), args.world)
    _show(out.counts())
    sys.exit(0 if out.passed() else 1)


def verify_folders(args) -> None:
    from stratum.operators.compare import compare_trees
    from stratum.sources import trees

    out = compare_trees(trees.read_tree(_spark(), args.left), trees.read_tree(_spark(), args.right), args.exclude or ())
    _show(out.counts())
    if args.report:
        with open(args.report, "w", encoding="utf-8") as f:
            f.write(out.report(args.left, args.right))
    sys.exit(0 if out.passed() else 1)


def thumbnail(args) -> None:
    from stratum.codecs.raster import colours_of

    v = _vault(args)
    sid = _id(v, args.snapshot)
    with open(args.colours, encoding="utf-8") as f:
        table = json.load(f)
    _show(v.ensure_tiles(sid, colours_of(table)))
    _show(v.make_sidecars(sid))
    if args.out:
        v.write_sidecars(sid, args.out)


def browse(args) -> None:
    for r in _vault(args).playback().toLocalIterator():
        print(r["json"])


def retime(args) -> None:
    v = _vault(args)
    v.backup_registry()
    v.retime(_id(v, args.snapshot), args.timestamp_ms)


def repair_timestamps(args) -> None:
    v = _vault(args)
    v.fsck(repair=True)
    _show(v.repair_timestamps(dry_run=not args.apply))


def migrate(args) -> None:
    v = _vault(args)
    v.fsck(repair=True)
    _show(v.migrate(dry_run=not args.apply))


def logs_list(args) -> None:
    _rows(_vault(args).logs())


def logs_extract(args) -> None:
    v = _vault(args)
    print(v.extract_logs(_id(v, args.snapshot, True), args.dest, args.server))


def logs_delete(args) -> None:
    v = _vault(args)
    v.delete_logs(_id(v, args.snapshot, True))


def summary(args) -> None:
    _show(_vault(args).summary())


def places(args) -> None:
    from stratum.plans.places import Places

    p, kind = Places(args.config), {"repo": "repos", "source": "source_paths"}[args.command]
    if args.action == "list":
        _show(p.list(kind))
    else:
        print(p.add(kind, args.path, args.label or "") if args.action == "add" else p.remove(kind, args.path))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratum", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, run, *arguments, vault=True):
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        if vault:
            c.add_argument("--vault", default=os.environ.get("STRATUM_VAULT", "vault"))
        for flags, options in arguments:
            c.add_argument(*flags.split(), **options)

    word, many, flag, number = {}, {"action": "append"}, {"action": "store_true"}, {"type": int}
    out = [("--json", word), ("--png", {"help": "folder for the pictures"}), ("--html", word), ("--tiles", {"help": "address of background pictures, with {dimension}"})]
    command("diff", diff_trees, ("old", word), ("new", word), *out, vault=False)
    command("render", diff_trees, ("old", word), ("new", word), *out, vault=False)
    command("diff-snaps", diff_snaps, ("old", word), ("new", word), *out)
    command("snapshot", snapshot, ("world", word), ("--label", word), ("--world-name", {"default": "world"}), ("--timestamp-ms", number), ("--exclude", many), ("--no-verify", flag), ("--allow-live", flag))
    command("list", list_, ("--limit", number))
    command("restore", restore, ("snapshot", word), ("dest", word), ("--path", many))
    command("delete", delete, ("snapshot", word))
    command("gc", gc)
    command("fsck", fsck, ("--repair", flag))
    command("verify", verify, ("--repair", flag))
    command("ingest", ingest, ("archive", {"nargs": "+"}), ("--timestamp-ms", number), ("--skip-logs", flag), ("--no-verify", flag), ("--server", word))
    command("import", import_, ("archive", word), ("--label", word), ("--world-subpath", word))
    command("servers", servers, ("archive", word), vault=False)
    command("verify-roundtrip", verify_roundtrip, ("snapshot", word), ("world", word))
    command("verify-folders", verify_folders, ("left", word), ("right", word), ("--exclude", many), ("--report", word), vault=False)
    command("thumbnail", thumbnail, ("snapshot", word), ("--colours", {"required": True, "help": "JSON: block name to colour number"}), ("--out", word))
    command("browse", browse)
    command("retime", retime, ("snapshot", word), ("timestamp_ms", number))
    command("repair-timestamps", repair_timestamps, ("--apply", flag))
    command("migrate-region-files", migrate, ("--apply", flag))
    command("logs-list", logs_list)
    command("logs-extract", logs_extract, ("snapshot", word), ("dest", word), ("--server", word))
    command("logs-delete", logs_delete, ("snapshot", word))
    command("summary", summary)
    for kind in ("repo", "source"):
        command(kind, places, ("action", {"choices": ("list", "add", "remove")}), ("path", {"nargs": "?"}), ("--label", word), ("--config", {"default": "~/.stratum.json"}), vault=False)
    return top


def main(argv=None) -> None:
    args = parser().parse_args(argv)
    try:
        args.run(args)
    except KeyboardInterrupt:
        sys.exit(130)
    except BrokenPipeError:
        sys.exit(0)


if __name__ == "__main__":
    main()
