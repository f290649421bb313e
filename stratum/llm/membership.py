"""Bloom filters of ids as small tables, to let most rows pass a join without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.exact_dedup import BLOCK, bit_set, filter_bits
from stratum.llm.scratch import settle

HASHES = 2


def _position(ids: list[Column], bits: int, i: int) -> Column:
    return F.xxhash64(*ids, F.lit(i)).bitwiseAND(F.lit(bits - 1))


def flag_members(rows: DataFrame, keys: list[str], ids: DataFrame, flag: str, max_filter_bits: int = 1 << 28) -> DataFrame:
    """rows with a boolean ``flag``: false only where rows' keys are surely not among ids (its columns, in that order).

    rows is an operator's own frame, without columns called member_*. The filter that is broadcast has at most
    max_filter_bits (32 MB), whatever the number of ids, once for each of two hashes; a full one flags more rows.
    """
    bits = filter_bits(ids.count(), 32, max_filter_bits)
    spots = ids.select(F.explode(F.array(*[_position([F.col(c) for c in ids.columns], bits, i) for i in range(HASHES)])).alias("p"))
    blocks = settle(spots.groupBy(F.expr(f"p div {BLOCK}").alias("block")).agg(F.bitmap_construct_agg(F.expr(f"p % {BLOCK}")).alias("bits")), "members")
    out, both = rows, F.lit(True)
    for i in range(HASHES):
        side = F.broadcast(blocks.select(F.col("block").alias(f"member_block{i}"), F.col("bits").alias(f"member_bits{i}")))
        out = out.withColumn(f"member_at{i}", _position([F.col(k) for k in keys], bits, i)).join(side, F.expr(f"member_at{i} div {BLOCK}") == F.col(f"member_block{i}"), "left")
        both = both & bit_set(F.col(f"member_bits{i}"), F.expr(f"member_at{i} % {BLOCK}"))
    return out.select(*rows.columns, both.alias(flag))
