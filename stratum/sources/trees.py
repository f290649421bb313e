"""File trees and archives as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import binary as B
from stratum.functions import paths as P

DEPTH = 5  # of a folder below the root that may hold region files


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path


def read_tree(spark: SparkSession, root: str, mounted: bool = False) -> DataFrame:
    """(rel, size, modified_ms, content) of all files below root; content is read only where it is used.

    Spark's file source leaves out empty files and names that start with a dot or an underscore. With ``mounted``, root is a folder that
    all executors see at one path, and tasks walk it themselves, one for each of its entries: nothing is left out.
    """
    if mounted:
        return _walked(spark, _local(root).rstrip("/"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    clean = F.regexp_replace("path", r"^file:/+", "/")
    rel = F.expr(f"substring(_p, {len(_local(root).rstrip('/')) + 2})") if "://" not in root or root.startswith("file://") else F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")
    return files.withColumn("_p", clean).select(rel.alias("rel"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"), "content")


def _walked(spark: SparkSession, root: str) -> DataFrame:
    def walk(batches):
        import os

        import pyarrow as pa

        def files(path):
            if os.path.isfile(path):
                yield path
            for folder, _, names in os.walk(path):
                for n in names:
                    yield os.path.join(folder, n)

        for batch in batches:
            for top in batch.column(0).to_pylist():
                for path in files(os.path.join(root, top)):
                    try:
                        with open(path, "rb") as f:
                            data = f.read()
                        when = int(os.path.getmtime(path) * 1000)
                    except OSError:
                        continue
                    row = (os.path.relpath(path, root).replace(os.sep, "/"), len(data), when, data)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["rel", "size", "modified_ms", "content"])

    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    tops = [(s.getPath().getName(),) for s in fs.listStatus(p)] if fs.exists(p) else []
    kind = "rel string, size long, modified_ms long, content binary"
    if not tops:
        return spark.createDataFrame([], kind)
    return spark.createDataFrame(tops, "top string").repartition(max(1, min(len(tops), 1000))).mapInArrow(walk, kind)


def below(tree: DataFrame, folder: str) -> DataFrame:
    """The part of a tree below one of its folders, with paths from there."""
    return tree if folder == "." else tree.filter(F.col("rel").startswith(folder + "/")).withColumn("rel", F.expr(f"substring(rel, {len(folder) + 2})"))


def region_files(tree: DataFrame) -> DataFrame:
    """tree's region files with dimension_key, rx, rz. A folder with region files hides those below it."""
    rows = tree.withColumn("dimension_key", F.when(F.col("rel").contains("/"), F.regexp_replace("rel", "/[^/]*$", "")).otherwise("."))
    rows = rows.filter(F.col("rel").rlike(P.REGION_PATTERN)).withColumn("rx", F.regexp_extract("rel", P.REGION_PATTERN, 1).try_cast("int")).withColumn("rz", F.regexp_extract("rel", P.REGION_PATTERN, 2).try_cast("int"))
    rows = rows.filter(F.col("rx").isNotNull() & F.col("rz").isNotNull() & ((F.col("dimension_key") == ".") | (F.size(F.split("dimension_key", "/")) <= DEPTH)))
    dims = rows.select(F.col("dimension_key").alias("_d")).distinct()
    parts = F.split("_d", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    steps = dims.select("_d", F.explode(F.concat(F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>")), F.when(F.col("_d") != ".", F.array(F.lit("."))).otherwise(F.array().cast("array<string>")))).alias("_up"))
    hidden = steps.join(dims.withColumnRenamed("_d", "_up"), "_up", "left_semi").select(F.col("_d").alias("dimension_key")).distinct()
    return rows.join(hidden, "dimension_key", "left_anti")


SIDE_PATTERN = r"(?:^|/)c\.(-?\d+)\.(-?\d+)\.mcc$"


def side_files(tree: DataFrame) -> DataFrame:
    """(dimension_key, wx, wz, mcc): payloads that lie beside their region."""
    return tree.filter(F.col("rel").rlike(SIDE_PATTERN)).select(
        F.when(F.col("rel").contains("/"), F.regexp_replace("rel", "/[^/]*$", "")).otherwise(".").alias("dimension_key"),
        F.regexp_extract("rel", SIDE_PATTERN, 1).try_cast("int").alias("wx"), F.regexp_extract("rel", SIDE_PATTERN, 2).try_cast("int").alias("wz"), F.col("content").alias("mcc"),
    )


def _world(rows: DataFrame) -> DataFrame:
    return rows.withColumn("wx", P.world_coord(F.col("rx"), F.col("cx"))).withColumn("wz", P.world_coord(F.col("rz"), F.col("cz")))


def scanned_cells(regions: DataFrame, tree: DataFrame) -> DataFrame:
    """Cells of regions (dimension_key, rx, rz, scan) with payload and hash; a payload that lies outside is joined, a missing one is empty."""
    rows = _world(regions.select("dimension_key", "rx", "rz", F.explode("scan.cells").alias("c")).select("dimension_key", "rx", "rz", "c.*"))
    rows = rows.join(side_files(tree), ["dimension_key", "wx", "wz"], "left")
    rows = rows.withColumn("payload", F.when(F.col("external"), F.coalesce("mcc", F.lit(b""))).otherwise(F.col("payload"))).drop("mcc")
    return rows.withColumn("content_hash", B.chunk_hash("compression", "payload"))


def cells(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, errors): every readable region's cells with payload and hash, and (rel, error) of unreadable regions.

    A cell whose payload is outside takes it from its .mcc file; a missing one is empty.
    """
    scanned = region_files(tree).withColumn("scan", B.scan_region("content"))
    errors = scanned.filter("scan.error is not null").select("rel", F.col("scan.error").alias("error"))
    return scanned_cells(scanned, tree), errors


def cell(tree: DataFrame, dimension: str, wx: int, wz: int) -> DataFrame:
    """The cell at world coordinates, or no row: just its own region file is read."""
    here = region_files(tree).filter((F.col("dimension_key") == dimension) & (F.col("rx") == wx >> 5) & (F.col("rz") == wz >> 5))
    found = scanned_cells(here.withColumn("scan", B.scan_region("content")), tree)
    return found.filter((F.col("cx") == wx & 31) & (F.col("cz") == wz & 31))


def scanned_refs(regions: DataFrame) -> DataFrame:
    """(rel, dimension_key, rx, rz, region_sha, cells, error) of region files with their content, in one pass that gives out no payloads.

    cells: array<struct<cx, cz, compression, timestamp, external, content_hash>>, the hash null for payloads that lie outside.
    """
    scanned = regions.select("rel", "dimension_key", "rx", "rz", "region_sha", B.scan_refs("content").alias("scan"))
    return scanned.select("rel", "dimension_key", "rx", "rz", "region_sha", "scan.cells", "scan.error")


def archive_entries(spark: SparkSession, path: str, content: bool = False, mounted: bool = False) -> DataFrame:
    """(archive, rel, size, modified_ms[, content]) of every file in zip and tar archives at or below path; entries that climb out fail.

    Entries leave one by one, so a task holds an archive and a few entries. With ``mounted``, path is one that all
    executors see, archives are opened there and may have any size; else Spark reads them, up to 2 GB each.
    """

    def read(batches):
        import calendar
        import io
        import tarfile
        import zipfile

        import pyarrow as pa

        def entries(name, data):
            source = data if data is not None else open(_local(name.replace("file:/", "/", 1) if name.startswith("file:/") and not name.startswith("file://") else name), "rb")
            source = io.BytesIO(source) if isinstance(source, bytes) else source
            if name.lower().endswith(".zip"):
                with zipfile.ZipFile(source) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            yield i.filename.replace("\\", "/"), i.file_size, calendar.timegm((*i.date_time, 0, 0, 0)) * 1000, lambda i=i: z.read(i)
            else:
                with tarfile.open(fileobj=source) as t:
                    for m in t:
                        if m.isfile():
                            yield m.name.removeprefix("./"), m.size, int(m.mtime * 1000), lambda m=m: t.extractfile(m).read()

        for batch in batches:
            for k in range(batch.num_rows):
                name, data = batch.column(0)[k].as_py(), None if mounted else batch.column(1)[k].as_py()
                for rel, _, _, _ in entries(name, data):  # before anything leaves
                    if rel.startswith("/") or ".." in rel.split("/"):
                        raise ValueError(f"{name}: entry {rel} climbs out of the archive")
                out, held = [], 0
                for rel, size, when, get in entries(name, data):
                    out.append((name, rel, size, when, get() if content else None))
                    held += size if content else 64
                    if held > 8_000_000 or len(out) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    import pyarrow as pa

    names, kinds = ["archive", "rel", "size", "modified_ms", "content"], (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.filter(P.archive_kind(F.col("path")).isNotNull())
    files = files.select("path").repartition("path") if mounted else files.select("path", "content")
    rows = files.mapInArrow(read, "archive string, rel string, size long, modified_ms long, content binary")
    return rows if content else rows.drop("content")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, size) of every archive below path, in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("archive"), F.col("length").alias("size"))
    return files.filter(P.archive_kind(F.col("archive")).isNotNull()).orderBy("archive")


def servers(region_rows: DataFrame) -> DataFrame:
    """(server, regions, dimensions): top folders that hold region files at any depth."""
    top = F.when(F.col("dimension_key").contains("/"), F.substring_index("dimension_key", "/", 1)).otherwise(".")
    return region_rows.groupBy(top.alias("server")).agg(F.count("*").alias("regions"), F.count_distinct("dimension_key").alias("dimensions"))
