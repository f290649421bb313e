"""The pool of distinct payloads and the references to it. Reference counts are derived, never kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ref_counts(refs: DataFrame, hash_col: str = "hash", delta: Column | None = None) -> DataFrame:
    """References per hash, one per occurrence; or the sum of the deltas of an event log."""
    return refs.groupBy(hash_col).agg((F.count("*") if delta is None else F.sum(delta)).cast("long").alias("ref_count"))


def unseen(candidates: DataFrame, pool: DataFrame, hash_col: str = "hash") -> DataFrame:
    """Distinct hashes of candidates that the pool lacks."""
    return candidates.select(hash_col).distinct().join(pool.select(hash_col), hash_col, "left_anti")


def present(candidates: DataFrame, pool: DataFrame, hash_col: str = "hash") -> DataFrame:
    return candidates.join(pool.select(hash_col), hash_col, "left_semi")


def missing_references(refs: DataFrame, pool: DataFrame, hash_col: str = "hash") -> DataFrame:
    """Reference occurrences whose payload is gone."""
    return refs.join(pool.select(hash_col), hash_col, "left_anti")


def orphans(pool: DataFrame, refs: DataFrame, hash_col: str = "hash") -> DataFrame:
    """Pool rows that nothing refers to: what a collection removes."""
    return pool.join(refs.select(hash_col), hash_col, "left_anti")


def growth(refs: DataFrame, snapshot: str, hash_col: str = "hash") -> DataFrame:
    """Hashes first seen in each snapshot, and their running total over snapshots in order."""
    first = refs.groupBy(hash_col).agg(F.min(snapshot).alias(snapshot))
    per = refs.select(snapshot).distinct().join(first.groupBy(snapshot).agg(F.count("*").alias("new_hashes")), snapshot, "left").na.fill(0, ["new_hashes"])
    # One row a snapshot: the running total is over the registry's size, not over the references.
    return per.withColumn("pool_size", F.sum("new_hashes").over(W.orderBy(snapshot)))


def complete_entries(entries: DataFrame, pool: DataFrame, entry: str, hash_col: str = "hash") -> DataFrame:
    """Entries and whether the pool has every hash of theirs."""
    has = pool.select(F.col(hash_col).alias("_h")).distinct()
    return entries.join(has, F.col(hash_col) == F.col("_h"), "left").groupBy(entry).agg(F.bool_and(F.col("_h").isNotNull()).alias("valid"), F.count("*").alias("hashes"))
