"""Best-fit decreasing packing of token sequences.

Documents of one length are alike to the packer, so best-fit decreasing runs on the histogram of lengths: a segment
tree over remaining capacities finds the tightest open bins in logarithmic time, and one step serves a whole run of
documents and bins. The histogram and the plan are bounded by the sequence length (at most about 3 * size open
intervals of bins), whatever the corpus; executors tokenize, rank documents within their length and look up the plan.
"""

from __future__ import annotations

import json
import zlib
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.llm.columns import col
from stratum.llm.scratch import documents, settle
from stratum.llm.tokens import id_bytes
from stratum.llm.workers import stream, tidy


class CapacityTree:
    """Which remaining capacities 0..size have open bins; at_least finds the smallest one that fits."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, value: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = value
        while i := i // 2:
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def at_least(self, capacity: int) -> int | None:
        i = capacity + self.leaves
        if self.any[i]:
            return capacity
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank_from, rank_to, bin_from, per_bin, offset) of best-fit decreasing.

    The document of that length with rank r goes to bin bin_from + (r - rank_from) // per_bin, at
    offset + (r - rank_from) % per_bin * length.
    """
    tree, bins = CapacityTree(size), [deque() for _ in range(size + 1)]
    runs, opened = [], 0

    def put(capacity: int, first: int, count: int, front: bool = False) -> None:
        if count:
            (bins[capacity].appendleft if front else bins[capacity].append)((first, count))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.at_least(length)
            if capacity is None:
                capacity, per = size, size // length
                put(size, opened, need := -(-left // per))
                opened += need
            first, count = bins[capacity].popleft()
            if not bins[capacity]:
                tree.set(capacity, False)
            per = capacity // length
            whole = min(count, left // per)
            if whole:
                runs.append((length, rank, rank + whole * per, first, per, size - capacity))
                put(capacity - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            if whole < count and left:  # fewer than one more bin takes
                runs.append((length, rank, rank + left, first + whole, left, size - capacity))
                put(capacity - left * length, first + whole, 1)
                whole, left = whole + 1, 0
            put(capacity, first + whole, count - whole, front=True)
    return runs


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int, size: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, _task, _nth): _nth counts a task's pieces of one length from 0."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        ids, end, seen = id_bytes(tokenizer_path), end_id.to_bytes(4, "little"), [0] * (size + 1)
        for batch in batches:
            rows, cols = [], ([], [], [], [], [])
            piece, start, length, crc, nth = cols
            for at, text in enumerate(stream(batch.column(1))):
                data = (ids(text) if text else b"") + end
                view, n = memoryview(data), len(data) // 4
                begin, stop = 0, (n - 1) % size + 1
                k = 0
                while begin < n:
                    rows.append(at)
                    piece.append(k)
                    start.append(begin)
                    length.append(stop - begin)
                    crc.append(zlib.crc32(view[4 * begin : 4 * stop]))
                    nth.append(seen[stop - begin])
                    seen[stop - begin] += 1
                    begin, stop, k = stop, stop + size, k + 1
            doc = batch.column(0).take(pa.array(rows, pa.int64()))
            own = [pa.array(c, kind) for c, kind in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([doc, *own[:4], pa.array(np.full(len(rows), task, "i4")), own[4]], ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_nth"])
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return narrow.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length int, ids_crc32 long, _task int, _nth long")


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id``; a null or empty text is just end_id. Only documents longer than
    ``size`` are cut, so that every piece but the first is full. Pieces are packed by best-fit decreasing; a
    sequence's offsets are gapless from 0. Null and repeated ids are packed like any other row; columns other than
    id and text are not read. An empty table gives an empty result.
    """
    cut = settle(pieces(docs, id_col, text_col, tokenizer_path, end_id, size), "pieces")
    counts = cut.groupBy("length", "_task").agg(F.count("*").alias("n"))
    counts = settle(counts, "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``size`` rows
    by_length: dict[int, list[dict]] = {}
    for length, a, b, first, per, offset in plan(histogram, size):
        by_length.setdefault(length, []).append({"a": a, "b": b, "first": first, "per": per, "offset": offset})
    before = F.sum("n").over(W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1))
    # Ranks start anew in each task. The table of tasks and lengths grows with the tasks (at most ``size`` rows for each), so
    # the planner picks the join by the size that the written table has, and broadcasts it only below its threshold.
    starts = counts.select(F.col("length").alias("_l"), F.col("_task").alias("_t"), F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = cut.join(starts, (F.col("length") == F.col("_l")) & (F.col("_task") == F.col("_t"))).withColumn("_rank", F.col("_before") + F.col("_nth"))
    runs = F.from_json(F.lit(json.dumps([by_length.get(n, []) for n in range(size + 1)])), F.lit("array<array<struct<a:bigint,b:bigint,first:bigint,per:bigint,offset:bigint>>>"))
    run = F.get(F.filter(F.get(runs, F.col("length")), lambda r: (r["a"] <= F.col("_rank")) & (F.col("_rank") < r["b"])), 0)
    out = ranked.withColumn("_run", run).withColumn("_at", F.col("_rank") - F.col("_run.a"))
    return out.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        F.expr("_run.first + _at div _run.per").alias("sequence_id"), F.expr("_run.offset + _at % _run.per * length").alias("offset"),
    )


def op7_packing(spark, sf_dir):
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
