"""The append-only registry of snapshots, and choices among its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratum.functions.paths import retitled


def current(log: DataFrame, id_col: str = "snapshot_id", seq: str = "seq") -> DataFrame:
    """The latest row of each id, of those whose latest state is committed. Filtering first would bring back deleted ones."""
    last = log.groupBy(id_col).agg(F.max_by(F.struct(*log.columns), seq).alias("r")).select("r.*")
    return last.filter("state = 'committed'")


def newest_first(registry: DataFrame, ts: str, id_col: str, limit: int | None = None) -> DataFrame:
    out = registry.orderBy(F.desc(ts), id_col)
    return out.limit(limit) if limit else out


def resolve(wanted: DataFrame, registry: DataFrame, id_col: str, label: str, ts: str, name: str = "name") -> DataFrame:
    """name and id: by exact id, else the latest of that label, else the latest whose id starts with it (any ASCII case)."""
    i, w = F.col(id_col).cast("string"), F.col(name)
    exact = registry.select(F.lit(1).alias("p"), id_col, ts, i.alias("_at"))
    titled = registry.select(F.lit(2).alias("p"), id_col, ts, F.col(label).alias("_at"))
    direct = wanted.join(exact.unionByName(titled), w == F.col("_at")).select(name, "p", id_col, ts)
    # Every id under each of its beginnings (as many as it has characters), so that the join is one of equal keys.
    starts = registry.select(id_col, ts, F.explode(F.transform(F.sequence(F.lit(1), F.length(i)), lambda n: F.lower(F.substring(i, F.lit(1), n)))).alias("_at"))
    prefix = wanted.join(starts, F.lower(w) == F.col("_at")).select(name, F.lit(3).alias("p"), id_col, ts)
    order = W.partitionBy(name).orderBy("p", F.desc(ts), id_col)
    return direct.unionByName(prefix).withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(name, id_col, F.col("p").alias("matched_by"))


def find(rows: DataFrame, name: str, id_col: str, label: str, ts: str) -> str | None:
    """The id that one name stands for: the registry is filtered, not joined, so its size costs one scan."""
    i = F.col(id_col).cast("string")
    rank = F.when(i == name, 1).when(F.col(label) == name, 2).when(F.startswith(F.lower(i), F.lit(name.lower())), 3)
    row = rows.withColumn("p", rank).filter("p is not null").orderBy("p", F.desc(ts), id_col).select(id_col).first()
    return row[0] if row else None


def latest_per(registry: DataFrame, world: str, ts: str, id_col: str) -> DataFrame:
    """The newest row of each world, ties to the smaller id."""
    return registry.withColumn("_r", F.row_number().over(W.partitionBy(world).orderBy(F.desc(ts), id_col))).filter("_r = 1").drop("_r")


def duplicate_groups(registry: DataFrame, *keys: str) -> DataFrame:
    return registry.groupBy(*keys).agg(F.count("*").alias("size")).filter("size > 1")


def duplicate_winners(registry: DataFrame, keys: list[str], wrong: Column, id_col: str) -> DataFrame:
    """Members of groups of two or more, with ``winner``: a rightly dated one first, then the smallest id."""
    group = W.partitionBy(*keys)
    out = registry.withColumn("_n", F.count("*").over(group)).withColumn("_r", F.row_number().over(group.orderBy(wrong.cast("int"), id_col)))
    return out.filter("_n > 1").withColumn("winner", F.col("_r") == 1).drop("_n", "_r")


def collisions(plan: DataFrame, registry: DataFrame, id_col: str, label: str, ts: str, new_label: str, new_ts: str) -> DataFrame:
    """Planned rows whose new (label, time) another row has; null labels never collide."""
    other = registry.select(F.col(id_col).alias("other_id"), F.col(label).alias("_l"), F.col(ts).alias("_t"))
    return plan.join(other, (F.col(new_label) == F.col("_l")) & (F.col(new_ts) == F.col("_t")) & (F.col(id_col) != F.col("other_id"))).drop("_l", "_t")


def repair_plan(registry: DataFrame, id_col: str, world: str, ts: str, target: str, label: str) -> DataFrame:
    """registry with action (delete, retime or keep) and new_label. Rows without a target are kept as they are."""
    group = W.partitionBy(world, target)
    place = F.row_number().over(group.orderBy((F.col(ts) != F.col(target)).cast("int"), id_col))
    known = registry.filter(F.col(target).isNotNull()).withColumn("_r", place)
    action = F.when(F.col("_r") > 1, "delete").when(F.col(ts) != F.col(target), "retime").otherwise("keep")
    title = F.when(action == "retime", retitled(F.col(label), F.col(world), F.col(ts), F.col(target))).otherwise(F.col(label))
    rest = registry.filter(F.col(target).isNull()).withColumn("action", F.lit("keep")).withColumn("new_label", F.col(label))
    return known.withColumn("action", action).withColumn("new_label", title).drop("_r").unionByName(rest)


def state_changes(states: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the key's previous one; the first of each key counts."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(*order))
    return states.withColumn("previous", before).filter(F.col("previous").isNull() | (F.col("previous") != F.col(value)))


def first_per(rows: DataFrame, key: str | list[str], *order) -> DataFrame:
    """The first row of each key (a column, or several) in order."""
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def unknown_labels(rows: DataFrame, registry: DataFrame, label: str) -> DataFrame:
    """The rows whose label no row of the registry has: what an ingest still has to take."""
    return rows.join(registry.select(label).distinct(), label, "left_anti")
