"""Checks of tables against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(index: DataFrame, manifests: DataFrame, key: str) -> DataFrame:
    """key and state: dangling (index only), orphan (manifest only) or ok."""
    a, b = index.select(key, F.lit(True).alias("_i")), manifests.select(key, F.lit(True).alias("_m"))
    state = F.when(F.col("_m").isNull(), "dangling").when(F.col("_i").isNull(), "orphan").otherwise("ok")
    return a.join(b, key, "full").select(key, state.alias("state"))


def under_referenced(want: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """key, want, have of counts below what is wanted; surplus is no fault."""
    out = want.select(key, F.col("ref_count").alias("want")).join(have.select(key, F.col("ref_count").alias("have")), key, "left")
    return out.select(key, "want", F.coalesce("have", F.lit(0)).cast("long").alias("have")).filter("have < want")


def verify_counts(blobs: DataFrame, fine: Column) -> DataFrame:
    return blobs.agg(F.count_if(fine).alias("ok"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("corrupt"))


def roundtrip(source: DataFrame, restored: DataFrame, key: str, value: str = "hash", excluded: Column | None = None) -> DataFrame:
    """key and status: missing, extra, hash_mismatch. Excluded keys may be missing."""
    a, b = source.select(key, F.col(value).alias("_s")), restored.select(key, F.col(value).alias("_r"))
    status = F.when(F.col("_r").isNull(), "missing").when(F.col("_s").isNull(), "extra").when(F.col("_s") != F.col("_r"), "hash_mismatch")
    out = a.join(b, key, "full").select(key, status.alias("status")).filter("status is not null")
    return out if excluded is None else out.filter(~((F.col("status") == "missing") & excluded))
