"""Size-balanced sharding by sampled splitters, in DataFrame operations only.

Rows are ordered by (hash of the text, id, row number). A size-weighted sample of these keys, bounded by a parameter, gives
quantile boundaries; rows are range-partitioned by them (a binary search over a literal array), and ranges that turn
out overfull are sampled again and subdivided, inside one text's copies too, as id and row number are part of the key.
Exact totals of the ranges then place every row on the line of all bytes, which is cut into equal shards; the copies of a
text go together, unless they are so many bytes that shards would differ.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.llm.columns import col
from stratum.llm.scratch import documents, settle

LEAST_LONG = -(1 << 63)
MOST_LONG = (1 << 63) - 1


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5, so that equal texts are neighbours."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _literal(rows: list, ddl: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), F.lit(ddl))


def _range_of(bounds: list[tuple[int, int, int]]) -> Column:
    """How many of the sorted bounds lie at or below (key, tie, nth): a binary search in log2 steps."""
    if not bounds:
        return F.lit(0)
    steps = 1 << (len(bounds).bit_length() - 1)
    walk = []
    while steps:
        walk.append(steps)
        steps //= 2
    arr = _literal([{"k": k, "t": t, "n": n} for k, t, n in bounds], "array<struct<k:bigint,t:bigint,n:bigint>>")
    here = F.struct(F.col("key").alias("k"), F.col("tie").alias("t"), F.col("nth").alias("n"))
    return F.aggregate(
        F.array(*map(F.lit, walk)),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(arr, at + step - 1) <= here), at + step).otherwise(at),
    )


def _sampled(rows: DataFrame, chance: Column, seed: int) -> list[tuple[int, int, int]]:
    """Sorted keys, each row drawn with the given chance by a seeded hash of its key. The chances bound the count."""
    drawn = F.pmod(F.xxhash64("key", "tie", "nth", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return sorted((r[0], r[1], r[2]) for r in rows.filter(drawn < chance).select("key", "tie", "nth").collect())


def _quantiles(sample: list, parts: int) -> list:
    """At most parts - 1 boundaries at equal steps of the sorted sample."""
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def range_bounds(rows: DataFrame, ranges: int, oversample: int, seed: int, rounds: int = 2) -> list[tuple[int, int, int]]:
    """Boundaries of about ``ranges`` ranges of equal bytes. Collects at most about ranges * oversample keys at a time."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    bounds = _quantiles(_sampled(rows, F.col("size") * (ranges * oversample / total), seed), ranges)
    for again in range(rounds):
        sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy(_range_of(bounds).alias("r")).agg(F.sum("size"), F.count("*")).collect()}
        over = {r: b for r, (b, n) in sizes.items() if b > 2 * total / ranges and n > 1}
        if not over:
            break
        inside = rows.filter(_range_of(bounds).isin(list(over)))
        keys = _sampled(inside, F.col("size") * (ranges * oversample / total), seed + 1 + again)
        edges = [(LEAST_LONG,) * 3, *bounds, (MOST_LONG,) * 3]
        more = set()
        for r, b in over.items():
            own = [k for k in keys if edges[r] <= k < edges[r + 1]]
            more.update(_quantiles(own, -(-int(b * ranges) // total)))
        if more <= set(bounds):
            break
        bounds = sorted({*bounds, *more})
    return bounds


def _large_groups(rows: DataFrame, bounds: list, limit: float) -> list[int]:
    """Keys of the bounds whose rows have over ``limit`` bytes. They are at most as many as the bounds."""
    inside = rows.filter(F.col("key").isin(sorted({b[0] for b in bounds})))
    return [r[0] for r in inside.groupBy("key").agg(F.sum("size").alias("b")).filter(F.col("b") > limit).select("key").collect()]


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, oversample: int = 16, seed: int = 7, together: float = 0.01) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: documents stand on one line in the order of (text hash, id), and a shard is a stretch of
    equally many bytes; a document goes where its middle falls, so a shard is off by one longest document at most. Equal
    texts are neighbours; copies of up to ``together`` of a shard's bytes go as one where their middle falls, and only
    larger groups are cut like single documents. Size is the text's UTF-8 bytes plus 8; a null text has none. A null
    id sorts first; rows that repeat text and id keep separate slots, in any order. ``slot`` counts a shard's rows from 0
    without gaps. ``grown_shard`` is null, as this law redraws the cuts. Other columns of docs are not read. An empty table
    gives an empty result. ``ranges`` (default: one for each 20,000 rows, 256 to 8192) are the stretches that tasks sort;
    at most about ``ranges * oversample`` keys and ``2 * ranges`` totals reach the driver.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    id_ = col(id_col).cast("long")
    rows = settle(
        docs.select(
            id_.alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key(col(text_col)).alias("key"),
            F.coalesce(id_, F.lit(LEAST_LONG)).alias("tie"), F.monotonically_increasing_id().alias("nth"),
        ),
        "shard-keys",
    )
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = ranges or min(8192, max(256, n_rows // 20_000))
    limit = n_bytes * together / shards
    bounds = range_bounds(rows, ranges, oversample, seed)
    large = set(_large_groups(rows, bounds, limit))
    bounds = sorted({b if b[0] in large else (b[0], LEAST_LONG, LEAST_LONG) for b in bounds})  # small groups lie in one range
    placed = rows.withColumn("range", _range_of(bounds).cast("int"))
    totals = {r[0]: (r[1], r[2]) for r in placed.groupBy("range").agg(F.sum("size"), F.count("*")).collect()}
    bytes_before, rows_before, b, n = [], [], 0, 0
    for r in range(len(bounds) + 1):
        bytes_before.append(b)
        rows_before.append(n)
        b, n = b + totals.get(r, (0, 0))[0], n + totals.get(r, (0, 0))[1]
    total = max(b, 1)
    order = W.partitionBy("range").orderBy("key", "tie", "nth")
    group = W.partitionBy("range", "key")
    line = (
        placed.withColumn("start", F.get(_literal(bytes_before, "array<bigint>"), F.col("range")) + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row", F.get(_literal(rows_before, "array<bigint>"), F.col("range")) + F.row_number().over(order) - 1)
        .withColumn("copies", F.sum("size").over(group))
        .withColumn("first", F.min("start").over(group))
    )
    one = (F.col("copies") <= limit) & ~F.col("key").isin(sorted(large))  # a large group may have few bytes in this range
    middle = F.when(one, 2 * F.col("first") + F.col("copies")).otherwise(2 * F.col("start") + F.col("size"))
    line = settle(line.withColumn("middle", middle).withColumn("shard", F.expr(f"cast(middle * {shards} div {2 * total} as int)")).select("doc_id", "size", "text_crc32", "shard", "row"), "shard-line")
    first = {r[0]: r[1] for r in line.groupBy("shard").agg(F.min("row")).collect()}
    starts = _literal([first.get(s, 0) for s in range(shards)], "array<bigint>")
    return line.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.get(starts, F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark, sf_dir):
    return shard(documents(spark, sf_dir))
