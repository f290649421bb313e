"""What archives and trees hold: entry kinds, servers, previews and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.functions import paths as P
from stratum.operators import registry

#: Folders that a search for archives doesn't enter.
SKIPPED_FOLDERS = (
    "Windows", "WindowsApps", "Program Files", "Program Files (x86)", "ProgramData", "$Recycle.Bin", "System Volume Information", "AppData", "Local Settings", "Recovery",
    ".Trash", ".cache", "node_modules", ".git", "__pycache__", "venv", ".venv", "env", ".env", "site-packages", ".gradle", ".m2", ".npm", ".yarn", ".cargo",
)


def preview(entries: DataFrame, server: str, rel: str = "rel", size: str = "size") -> DataFrame:
    """Regions, dimensions, logs and bytes of each server's entries, of those servers that hold anything known."""
    k = F.col("kind")
    out = entries.withColumn("kind", P.entry_kind(F.col(rel))).groupBy(server)
    out = out.agg(
        F.count_if(k == "region").alias("regions"), F.bool_or(k == "level").alias("has_level"), F.count_if(k == "log").alias("logs"),
        F.count_distinct(F.when(k == "region", F.regexp_replace(rel, "/[^/]*$", ""))).alias("dimensions"),
        F.sum(F.when(k.isin("level", "region", "external"), F.col(size)).otherwise(0)).alias("world_bytes"),
        F.sum(F.when(k.isin("log", "crash"), F.col(size)).otherwise(0)).alias("log_bytes"), F.count_if(k != "other").alias("known"),
    )
    return out.filter("known > 0").drop("known")


def totals(previews: DataFrame) -> DataFrame:
    """One row over all servers' previews."""
    return previews.agg(F.count("*").alias("servers"), *[F.sum(c).alias(c) for c in ("regions", "logs", "world_bytes", "log_bytes")])


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")).cast("long")


def archive_scan(files: DataFrame, samples: int = 5, max_depth: int = 3) -> DataFrame:
    """One row: archive_count, total_bytes and the first names, of the archives at most max_depth folders below the root of (rel, size).

    No row if there is none. Folders known to hold no backups aren't looked into.
    """
    folders = F.slice(F.split("rel", "/"), 1, F.greatest(F.lit(0), F.size(F.split("rel", "/")) - 1))
    found = files.filter(P.archive_kind(F.col("rel")).isNotNull() & (depth(F.col("rel")) <= max_depth + 1) & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))))
    name = F.substring_index("rel", "/", -1)
    first = registry.newest_first(found.select(name.alias("name"), F.lit(0).alias("zero")), "zero", "name", samples).agg(F.sort_array(F.collect_list("name")).alias("samples"))
    return found.agg(F.count("*").alias("archive_count"), F.sum("size").alias("total_bytes")).filter("archive_count > 0").join(first, F.lit(True))  # two rows of one


def group_summary(rows: DataFrame, key: str, name: str, size: str, samples: int = 5) -> DataFrame:
    """files, bytes and the first names (joined by commas) of each key."""
    sums = rows.groupBy(key).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    few = rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(name))).filter(F.col("place") <= samples)
    return sums.join(few.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(name)), ",").alias("samples")), key)


def route(titled: DataFrame, named: DataFrame, server: str, order: str) -> DataFrame:
    """Each server's vault: one whose label fits goes before one whose folder name fits, then the first in order."""
    return registry.first_per(titled.withColumn("p", F.lit(0)).unionByName(named.withColumn("p", F.lit(1))), server, "p", order)


def choose_time(explicit: Column, played: Column, newest: Column) -> Column:
    """Milliseconds: the explicit time, else when the world was last played (if above 0), else the newest file's."""
    return F.coalesce(explicit, F.when(played > 0, played), newest)


def migration(files: DataFrame, path: str = "path") -> DataFrame:
    """files with action (migrate: region files below a folder; keep), dimension_key, rx and rz."""
    fits = F.col(path).rlike(P.REGION_PATTERN) & F.col(path).contains("/")
    part = lambda i: F.when(fits, F.regexp_extract(path, P.REGION_PATTERN, i).try_cast("long"))
    return files.withColumn("action", F.when(fits, "migrate").otherwise("keep")).withColumn("dimension_key", F.when(fits, F.regexp_replace(path, "/[^/]*$", ""))).withColumn("rx", part(1)).withColumn("rz", part(2))


def distinct_items(rows: DataFrame, group: str, items: Column, name: str) -> DataFrame:
    """(group, name): the distinct items of each group's arrays; empty strings and nulls don't count."""
    return rows.select(group, F.explode(items).alias(name)).filter(F.col(name) != "").distinct()


def discover_servers(files: DataFrame, regions: DataFrame, name: str) -> DataFrame:
    """(server, server_root, world_root) below a tree: every top folder with region files; without one, the tree itself as ``name``.

    The world's root is the deepest folder over all the folders that hold a server's region folders, moved up to the
    nearest one with a level.dat. files: (rel); regions: region files with dimension_key. Sums are per server, and a
    server has as many region folders as dimensions.
    """
    top = F.when(F.col("dimension_key").contains("/"), F.substring_index("dimension_key", "/", 1))
    dims = regions.select("dimension_key").distinct()
    # A region folder directly below the root has no server above it.
    nested = dims.filter(F.col("dimension_key").contains("/")).select(top.alias("server"), F.col("dimension_key").alias("dim"))
    flat = dims.filter(~F.col("dimension_key").contains("/")).select(F.lit(".").alias("server"), F.col("dimension_key").alias("dim"))
    alone = dims.filter((~F.col("dimension_key").contains("/")) & (F.col("dimension_key") != ".")).select(F.col("dimension_key").alias("server"), F.col("dimension_key").alias("dim"))
    named = nested.unionByName(alone)
    roots = named if named.limit(1).count() else flat
    parent = F.when(F.col("dim").contains("/"), F.regexp_replace("dim", "/[^/]*$", "")).otherwise(".")
    parent = F.when(F.col("dim") == F.col("server"), F.col("server")).otherwise(parent)
    groups = roots.select("server", F.split(parent, "/").alias("parts")).groupBy("server").agg(F.min("parts").alias("lo"), F.max("parts").alias("hi"))
    # The common prefix of all paths is that of the least and the greatest.
    same = F.aggregate(F.sequence(F.lit(1), F.least(F.size("lo"), F.size("hi"))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.element_at("lo", i) == F.element_at("hi", i)), i).otherwise(n))
    common = groups.select("server", F.slice("lo", 1, same).alias("parts"))
    steps = common.select("server", F.size("parts").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("parts"))), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("parts", 1, i), "/").alias("at")))).alias("s"))
    levels = files.filter(F.col("rel").rlike(r"(^|/)level\.dat$")).select(F.when(F.col("rel") == "level.dat", ".").otherwise(F.regexp_replace("rel", r"/level\.dat$", "")).alias("folder")).distinct()
    marked = steps.select("server", "n", "s.i", "s.at").join(levels, F.col("at") == F.col("folder"), "left")
    best = marked.groupBy("server").agg(F.max_by("at", F.when(F.col("folder").isNotNull(), F.col("i"))).alias("with_level"), F.max_by("at", "i").alias("deepest"))
    out = best.select("server", F.col("server").alias("server_root"), F.coalesce("with_level", "deepest").alias("world_root"))
    return out.withColumn("server", F.when(F.col("server") == ".", F.lit(name)).otherwise(F.col("server")))


def locate_world(files: DataFrame) -> DataFrame:
    """At most one row (folder): the root, else the first folder one and then two levels down, that has a level.dat or a region folder."""
    here = F.when(F.col("rel").rlike(r"(^|/)level\.dat$"), F.regexp_replace("rel", r"/?level\.dat$", "")).when(F.col("rel").rlike(r"(^|/)region/"), F.regexp_replace("rel", r"/?(^|/)region/.*$", ""))
    found = files.select(here.alias("folder")).filter("folder is not null").distinct().withColumn("levels", F.when(F.col("folder") == "", 0).otherwise(depth(F.col("folder"))))
    return found.filter("levels <= 2").orderBy("levels", "folder").limit(1).select(F.when(F.col("folder") == "", ".").otherwise(F.col("folder")).alias("folder"))
