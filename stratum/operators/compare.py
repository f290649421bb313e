"""Comparison of two trees: regions, their cells, and all other files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions import paths as P
from stratum.operators import diff
from stratum.sources import trees

REGION = ["dimension_key", "rx", "rz"]
CELL = [*REGION, "cx", "cz"]


def compare_regions(source: DataFrame, restored: DataFrame) -> DataFrame:
    """dimension_key, rx, rz and status (only_in_source, only_in_restore) of regions that just one side has."""
    a, b = source.select(*REGION).distinct(), restored.select(*REGION).distinct()
    out = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), REGION, "full").filter("a is null or b is null")
    return out.select(*REGION, F.when(F.col("b").isNull(), "only_in_source").otherwise("only_in_restore").alias("status"))


def compare_cells(source: DataFrame, restored: DataFrame) -> DataFrame:
    """Keys and status of the cells that differ, inside regions that both sides have."""
    common = source.select(*REGION).distinct().join(restored.select(*REGION).distinct(), REGION, "left_semi")
    a, b = (side.join(common, REGION, "left_semi") for side in (source, restored))
    status = F.when(F.col("kind") == "removed", "missing_in_restore").when(F.col("kind") == "added", "extra_in_restore").otherwise("hash_mismatch")
    return diff.full_diff(a, b, CELL, "content_hash").select(*CELL, status.alias("status"))


def compare_files(source: DataFrame, restored: DataFrame, exclude=()) -> DataFrame:
    """relative_path, status, source_size, restore_size. Both sides: (rel, size, sha256). Equal files have status ``equal``, and
    files that only an exclude pattern keeps out of the restored side ``excluded``. A side without the file has size -1."""
    a = source.select(F.col("rel").alias("relative_path"), F.col("size").alias("source_size"), F.col("sha256").alias("a"), F.lit(True).alias("in_a"))
    b = restored.select(F.col("rel").alias("relative_path"), F.col("size").alias("restore_size"), F.col("sha256").alias("b"), F.lit(True).alias("in_b"))
    status = (
        F.when(F.col("in_b").isNull() & P.matches_any(F.col("relative_path"), exclude), "excluded")
        .when(F.col("in_b").isNull(), "missing_in_restore")
        .when(F.col("in_a").isNull(), "extra_in_restore")
        .when((F.col("source_size") != F.col("restore_size")) | ~F.col("a").eqNullSafe(F.col("b")), "byte_mismatch")
        .otherwise("equal")
    )
    return a.join(b, "relative_path", "full").select("relative_path", status.alias("status"), *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("source_size", "restore_size")])


def differs(counts: dict[str, int]) -> bool:
    """Whether a comparison's counts tell of a difference. Unreadable regions alone don't."""
    return any(counts[k] for k in ("cell_mismatches", "file_mismatches", "missing_regions", "extra_regions"))


@dataclass
class Comparison:
    """Frames of what differs. ``errors`` are regions that one side couldn't read; they don't count against ``passed``."""

    regions: DataFrame
    cells: DataFrame
    files: DataFrame
    errors: DataFrame
    cells_checked: int = 0
    cells_matching: int = 0

    def counts(self) -> dict[str, int]:
        by = {r[0]: r[1] for r in self.files.groupBy("status").count().collect()}  # five rows at most
        sides = {r[0]: r[1] for r in self.regions.groupBy("status").count().collect()}
        files = by.get("equal", 0)
        mismatches = sum(by.get(k, 0) for k in ("missing_in_restore", "extra_in_restore", "byte_mismatch"))
        return {
            "cells_checked": self.cells_checked, "cells_matching": self.cells_matching, "cell_mismatches": self.cells.count(), "files_checked": files + by.get("byte_mismatch", 0), "files_matching": files, "file_mismatches": mismatches,
            "missing_regions": sides.get("only_in_source", 0), "extra_regions": sides.get("only_in_restore", 0), "excluded": by.get("excluded", 0), "errors": self.errors.count(),
        }

    def passed(self) -> bool:
        return not differs(self.counts())

    def report(self, left: str, right: str) -> str:
        """All differences as text, sorted. The text holds every difference, so it is for two trees that are nearly equal."""
        c = self.counts()
        lines = [f"left: {left}", f"right: {right}", ("FAIL " if differs(c) else "PASS ") + ", ".join(f"{k} {v}" for k, v in c.items())]
        for title, frame in (("regions", self.regions), ("cells", self.cells), ("files", self.files.filter("status <> 'equal'")), ("errors", self.errors)):
            rows = sorted(" ".join("-" if v is None else str(v) for v in r) for r in frame.toLocalIterator())
            lines += [f"## {title} ({len(rows)})", *(f"  {r}" for r in rows)] if rows else []
        return "\n".join(lines) + "\n"


def _other_files(tree: DataFrame, regions: DataFrame) -> DataFrame:
    rest = tree.filter(~F.col("rel").rlike(r"(^|/)c\.[^/]*\.mcc$")).join(regions.select("rel"), "rel", "left_anti")
    return rest.select("rel", "size", F.unhex(F.sha2("content", 256)).alias("sha256"))


def compare_trees(left: DataFrame, right: DataFrame, exclude=()) -> Comparison:
    """Two trees (rel, size, modified_ms, content) against each other; exclude patterns hold for the left one."""
    (a, bad_a), (b, bad_b) = trees.cells(left), trees.cells(right)
    cells = compare_cells(a, b)
    both = a.join(b.select(*[F.col(c).alias(f"b_{c}") for c in CELL], F.col("content_hash").alias("b_hash")), [F.col(c) == F.col(f"b_{c}") for c in CELL])
    checked = both.agg(F.count("*"), F.count_if(F.col("content_hash") == F.col("b_hash"))).first()
    files = compare_files(_other_files(left, trees.region_files(left)), _other_files(right, trees.region_files(right)), exclude)
    regions = compare_regions(trees.region_files(left), trees.region_files(right))
    errors = bad_a.withColumn("side", F.lit("left")).unionByName(bad_b.withColumn("side", F.lit("right")))
    return Comparison(regions, cells, files, errors, *checked)
