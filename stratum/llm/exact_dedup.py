"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass one counts how many rows touch each Bloom position (partial sums on the map side; positions shuffle, never rows)
and keeps the positions touched twice or more as a bitmap of at most ``max_filter_bits``. Pass two tests every row
against that bitmap: a row with an untouched position has a digest of its own and passes straight through. Only the
rows left over are grouped by digest. A saturated bitmap lets more rows into the grouping and never changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.columns import col, opened, whole
from stratum.llm.scratch import documents, settle, temporary

BLOCK = 32768  # bits in one block of bitmap_construct_agg


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _positions(digest: Column, bits: int, hashes: int) -> list[Column]:
    """Bloom positions, each from its own 13 hex digits of the digest."""
    return [F.conv(F.substring(F.hex(digest), 1 + 13 * i, 13), 16, 10).cast("long").bitwiseAND(F.lit(bits - 1)) for i in range(hashes)]


def filter_bits(rows: int, bits_per_row: int, max_filter_bits: int) -> int:
    """A power of two of at least bits_per_row * rows, and at most max_filter_bits."""
    bits = BLOCK
    while bits < rows * bits_per_row and bits < max_filter_bits:
        bits *= 2
    return bits


def repeated_positions(digests: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(block, bitmap) of the Bloom positions that two rows or more touch."""
    pos = digests.select(F.explode(F.array(*_positions(F.col("digest"), bits, hashes))).alias("p"))
    twice = pos.groupBy("p").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.groupBy(F.expr(f"p div {BLOCK}").alias("block")).agg(F.bitmap_construct_agg(F.expr(f"p % {BLOCK}")).alias("bits"))


def bit_set(bits: Column, offset: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (offset / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (offset % 8).cast("int")) == 1, F.lit(False))


def _judged(docs: DataFrame, row: Column, id_: Column, digest: Column, bits_per_row: int = 32, hashes: int = 2, max_filter_bits: int = 1 << 28) -> DataFrame:
    """(row, keep_id, group_size, kept, digest) of each row of docs, whose columns travel inside the struct ``row``."""
    base = docs.select(row, id_.alias("id"), digest.alias("digest"))
    bits = filter_bits(docs.count(), bits_per_row, max_filter_bits)
    with temporary() as tables:
        repeated = tables.keep(settle(repeated_positions(base.select("digest"), bits, hashes), "bloom"))
        marked, maybe = base, F.lit(True)
        for i, p in enumerate(_positions(F.col("digest"), bits, hashes)):
            side = F.broadcast(repeated.select(F.col("block").alias(f"block{i}"), F.col("bits").alias(f"bits{i}")))  # at most max_filter_bits / 8 bytes
            marked = marked.withColumn(f"p{i}", p).join(side, F.expr(f"p{i} div {BLOCK}") == F.col(f"block{i}"), "left")
            maybe = maybe & bit_set(F.col(f"bits{i}"), F.expr(f"p{i} % {BLOCK}"))
        marked = marked.select("row", "id", "digest", maybe.alias("maybe"))
        some = tables.keep(settle(marked.filter("maybe").select("row", "id", "digest", F.monotonically_increasing_id().alias("tag")), "maybe"))
    single = marked.filter("not maybe").select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    by_id = some.groupBy("digest", "id").agg(F.count("*").alias("n"), F.min("tag").alias("t"))
    low = F.coalesce(F.struct(F.col("id").isNotNull().alias("has"), F.col("id").alias("id")))
    groups = by_id.groupBy("digest").agg(F.sum("n").alias("group_size"), F.max("id").alias("keep_id"), F.max_by("t", low).alias("stay"))
    # The key is made anew, so both sides of the join are exchanged and Spark may split a digest with very many rows.
    groups = groups.select(F.concat(F.col("digest"), F.lit(b"")).alias("key"), "group_size", "keep_id", "stay")
    grouped = some.join(groups, F.col("digest") == F.col("key")).select("row", "keep_id", "group_size", (F.col("tag") == F.col("stay")).alias("kept"), "digest")
    return single.unionByName(grouped)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None, carry: list[str] | None = None, **filter_options) -> DataFrame:
    """docs' ``carry`` columns (default: all) with keep_id, group_size, kept and text_sha256.

    Rows are equal when their digests are (default: SHA-256 of the text, null as empty). Of equal rows the one with
    the largest id stays; a null id is smallest; among rows that repeat an id just one stays. An empty table gives
    an empty result. Output columns replace input columns of the same names; all other columns pass unchanged, whatever
    they are called. ``bits_per_row``, ``hashes`` and ``max_filter_bits`` (32 MB, which bounds what is broadcast at any
    input size) shape the filter and never the result.
    """
    docs_ = docs.select(*map(col, carry)) if carry else docs
    row = whole(docs_, ("keep_id", "group_size", "kept", "text_sha256"))
    out = _judged(docs, row, col(id_col), text_digest(col(text_col)) if digest is None else digest, **filter_options)
    return opened(out, F.col("keep_id"), F.col("group_size"), F.col("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **filter_options) -> DataFrame:
    """docs without the rows that exact_dedup drops, in docs' own columns."""
    return opened(_judged(docs, whole(docs), col(id_col), text_digest(col(text_col)), **filter_options).filter("kept"))


def op10_exact_dedup(spark, sf_dir):
    narrow = settle(documents(spark, sf_dir).select("doc_id", text_digest(F.col("text")).alias("digest")), "digests")
    return exact_dedup(narrow, digest=F.col("digest"), carry=["doc_id"])


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
