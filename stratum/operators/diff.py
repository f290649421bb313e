"""Differences between two keyed sets of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("added", "removed", "modified")


def full_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str = "hash", keep_equal: bool = False) -> DataFrame:
    """keys, kind, old_hash, new_hash of each key whose hash differs: one full outer join, equal rows dropped.

    A row with a null hash is there, and differs from any hash; rows whose keys hold a null meet those with the same.
    """
    a = old.select(*[F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)], F.col(value).alias("old_hash"), F.lit(True).alias("_old"))
    b = new.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], F.col(value).alias("new_hash"), F.lit(True).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified").otherwise("equal")
    both = a.join(b, [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys))], "full")
    out = both.select(*[F.when(F.col("_old").isNull(), F.col(f"_b{i}")).otherwise(F.col(f"_a{i}")).alias(k) for i, k in enumerate(keys)], kind.alias("kind"), "old_hash", "new_hash")
    return out if keep_equal else out.filter("kind <> 'equal'")


def count_by_kind(diff: DataFrame) -> DataFrame:
    """One row; kinds that don't occur count 0."""
    return diff.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])


def count_by(diff: DataFrame, *dims: str) -> DataFrame:
    return diff.groupBy(*dims).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])


def bounds(cells: DataFrame, *dims: str, x: str = "cx", z: str = "cz") -> DataFrame:
    """Extreme coordinates and extents by dimension."""
    out = cells.groupBy(*dims).agg(*[f(c).cast("long").alias(f"{n}_{c}") for c in (x, z) for n, f in (("min", F.min), ("max", F.max))])
    return out.withColumn("width", F.col(f"max_{x}") - F.col(f"min_{x}") + 1).withColumn("height", F.col(f"max_{z}") - F.col(f"min_{z}") + 1)


def diff_with_errors(old: DataFrame, new: DataFrame, keys: list[str], old_bad: Column, new_bad: Column, value: str = "hash") -> DataFrame:
    """full_diff in which a group unreadable on one side is empty there; a group bad on both sides isn't compared."""
    return full_diff(old.filter(~old_bad), new.filter(~new_bad), keys, value)


def two_level_diff(old: DataFrame, new: DataFrame, group: str, keys: list[str], value: str = "hash") -> DataFrame:
    """full_diff that first drops the groups whose content is the same on both sides, by one digest a group."""

    def digest(side: DataFrame, name: str) -> DataFrame:
        row = F.xxhash64(*keys, value)
        return side.groupBy(group).agg(F.struct(F.count("*"), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).alias(name))

    both = digest(old, "_x").join(digest(new, "_y"), group, "full").filter(~F.col("_x").eqNullSafe(F.col("_y"))).select(group)
    return full_diff(old.join(both, group, "left_semi"), new.join(both, group, "left_semi"), keys, value)
