"""Pictures and exchange files of cells and differences. Pictures are drawn in sheets of bounded size, each by one task."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.codecs import raster
from stratum.functions import paths as P
from stratum.operators import diff as D


def _sheeted(rows: DataFrame, side: int, stem) -> DataFrame:
    """rows (dimension_key, wx, wz) with x0, z0, width and height (in cells) of their sheet, and its ``name``."""
    low = rows.groupBy("dimension_key").agg(*[f(c).alias(n) for n, f, c in (("x0", F.min, "wx"), ("x1", F.max, "wx"), ("z0", F.min, "wz"), ("z1", F.max, "wz"))])
    out = rows.join(low, "dimension_key")
    sx, sz = F.floor((F.col("wx") - F.col("x0")) / side).cast("int"), F.floor((F.col("wz") - F.col("z0")) / side).cast("int")
    out = out.withColumn("sx", sx).withColumn("sz", sz)
    several = (F.col("x1") - F.col("x0") >= side) | (F.col("z1") - F.col("z0") >= side)
    place = F.when(several, F.concat(F.lit("."), F.col("sx").cast("string"), F.lit("."), F.col("sz").cast("string"))).otherwise("")
    out = out.withColumn("name", F.concat(P.safe_dimension(F.col("dimension_key")), stem, place, F.lit(".png")))
    for a, s, b, n in (("x0", "sx", "x1", "width"), ("z0", "sz", "z1", "height")):
        out = out.withColumn(a, F.col(a) + F.col(s) * side).withColumn(n, F.least(F.lit(side), F.col(b) - F.col(a) + 1).cast("int"))
    return out


def sheets(rows: DataFrame, side: int = 256) -> DataFrame:
    """(dimension_key, mode, name, width, height, png) of cells (dimension_key, mode, wx, wz, rgb); a null tile stays background."""

    def draw(table):
        import pyarrow as pa

        first = {c: table.column(c)[0].as_py() for c in ("dimension_key", "mode", "name", "x0", "z0", "width", "height")}
        cells = zip(*(table.column(c).to_pylist() for c in ("wx", "wz", "rgb")), strict=True)
        png = raster.mosaic([c for c in cells if c[2] is not None and len(c[2]) == 768], (first["x0"], first["z0"], first["width"], first["height"]))
        row = (first["dimension_key"], first["mode"], first["name"], first["width"] * raster.SIDE, first["height"] * raster.SIDE, png)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["dimension_key", "mode", "name", "width", "height", "png"])

    drawn = _sheeted(rows, side, F.concat(F.lit("-"), F.col("mode"))).select("dimension_key", "mode", "name", "x0", "z0", "width", "height", "wx", "wz", "rgb")
    return drawn.groupBy("dimension_key", "mode", "name").applyInArrow(draw, "dimension_key string, mode string, name string, width int, height int, png binary")


def heat_sheets(changes: DataFrame, side: int = 512, scale: int = 8) -> DataFrame:
    """(name, png) of changes (dimension_key, wx, wz, kind), a square of ``scale`` pixels each."""

    def draw(table):
        import pyarrow as pa

        cells = list(zip(*(table.column(c).to_pylist() for c in ("wx", "wz", "kind")), strict=True))
        bounds = tuple(table.column(c)[0].as_py() for c in ("x0", "z0", "width", "height"))
        return pa.table([pa.array([table.column("name")[0].as_py()]), pa.array([raster.heat_map(cells, scale, bounds)], pa.binary())], ["name", "png"])

    rows = _sheeted(changes.select("dimension_key", "wx", "wz", "kind"), side, F.lit("-diff")).select("name", "x0", "z0", "width", "height", "wx", "wz", "kind")
    return rows.groupBy("name").applyInArrow(draw, "name string, png binary")


def change_lines(changes: DataFrame) -> DataFrame:
    """(json) of each change in the order of its keys, hashes in hexadecimal."""
    old, new = (F.lower(F.hex(c)).alias(c) for c in ("old_hash", "new_hash"))
    row = F.struct(F.col("dimension_key").alias("dimension"), "rx", "rz", "cx", "cz", "kind", old, new)
    return changes.orderBy("dimension_key", "rx", "rz", "cx", "cz").select(F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def write_diff_json(changes: DataFrame, path: str, names: dict | None = None, errors: DataFrame | None = None) -> None:
    """One JSON file: names, summary, total, errors (if given) and all changes, written as they arrive."""
    counts = D.count_by_kind(changes).first().asDict()
    head = (names or {}) | {"summary": counts, "total": sum(counts.values())}
    if errors is not None:
        head["errors"] = [r.asDict() for r in errors.toLocalIterator()]
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(head)[:-1] + ', "changes": [')
        for i, r in enumerate(change_lines(changes).toLocalIterator()):
            f.write((",\n" if i else "\n") + r["json"])
        f.write("\n]}\n")


def map_page(title: str, changes: DataFrame, versions: dict | None = None, errors: int = 0, tiles_url: str | None = None) -> str:
    """The page of raster.map_page for a frame of changes, which it holds all: for differences that a browser can show."""
    rows = changes.select("dimension_key", "wx", "wz", "kind", F.lower(F.hex("old_hash")).alias("o"), F.lower(F.hex("new_hash")).alias("n")).toLocalIterator()
    return raster.map_page(title, [tuple(r) for r in rows], versions, errors, tiles_url)
