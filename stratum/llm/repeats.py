"""Removal of long repeated passages by suffix sorting with a difference cover.

A byte goes if some string of ``length`` bytes that covers it also starts anywhere else. Such strings agree in the
least hash of the k-grams inside them, so a document falls into runs of neighbouring windows with the same least hash,
the run's anchor. Windows can be equal only under one anchor, and runs whose anchor occurs once are done with. Equal runs
(by 128 bits of blake2b) repeat as a whole. The texts of the others, one for each distinct run, meet by anchor in bounded
groups, where all their suffixes are sorted by a difference cover (suffixes.py) and neighbours are compared byte by byte.
Anchors with too many distinct texts for one task take the same windows one by one, by 128 bits of blake2b, over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.columns import col
from stratum.llm.membership import flag_members
from stratum.llm.scratch import documents, settle, temporary
from stratum.llm.suffixes import MOST, suffix_order
from stratum.llm.words import eights, mix64
from stratum.llm.workers import slices, stream, tidy

GRAM = 32  # bytes of an anchor
HOT_TEXTS, HOT_BYTES = 500, 1_000_000  # beyond these an anchor is divided
BLOCK_BYTES = 1_000_000  # of such texts that are worked through at once
STRETCH = 2_000_000  # windows of a long text that are worked through at once; a run that is cut there only costs work
DOC = ("doc", "doc2")  # 128 bits


def _slide(values, width: int, pick):
    """pick (minimum or maximum) of every window of ``width`` values, from prefixes and suffixes of blocks."""
    import numpy as np

    edge = np.iinfo(values.dtype).max if pick is np.minimum else 0
    blocks = np.full(-(-len(values) // width) * width, edge, values.dtype)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    head, tail = pick.accumulate(blocks, 1).ravel(), pick.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return pick(tail[: len(values) - width + 1], head[width - 1 : len(values)])


def gram_hashes(data):
    """64-bit hashes of all strings of GRAM bytes, by doubling. They only name anchors: a collision costs work."""
    import numpy as np

    h = eights(data)[: len(data) - 7] * np.uint64(0x9E3779B97F4A7C15)
    for size, factor in ((8, 0xBF58476D1CE4E5B9), (16, 0x94D049BB133111EB)):
        h = h ^ (h >> np.uint64(29))
        h = h[:-size] * np.uint64(factor) + h[size:]
    return mix64(h)


def find_runs(data, length: int):
    """(start, windows, anchor, occurrences of the anchor's hash inside) of each run of a text's windows."""
    import numpy as np

    gram = gram_hashes(data)
    least = _slide(gram, length - GRAM + 1, np.minimum)
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    stop = np.concatenate((start[1:], [len(least)]))
    anchor = least[start]
    inside = stop - 1 + length
    # A run's own anchor: k-grams of that hash among those of its windows, counted in the order of hash and place.
    hits = np.flatnonzero(_slide(np.concatenate((np.zeros(length - GRAM, np.uint64), least, np.zeros(length - GRAM, np.uint64))), length - GRAM + 1, np.maximum) == gram)
    hashes, rank = np.unique(gram[hits], return_inverse=True)
    placed = np.sort(rank * len(data) + hits)
    own = np.searchsorted(hashes, anchor) * len(data)
    times = np.searchsorted(placed, own + inside - GRAM, side="right") - np.searchsorted(placed, own + start)
    return start, stop - start, anchor, times


def runs_of(texts: DataFrame, length: int) -> DataFrame:
    """(doc, doc2, start, windows, a, c1, c2, times) for the rows (doc, doc2, text) of texts; c1 and c2 name the run's text."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        names = ["doc", "doc2", "start", "windows", "a", "c1", "c2", "times"]
        for batch in batches:
            parts, size = [], 0

            def flush(parts):
                cols = [np.concatenate([p[i] for p in parts]) for i in range(len(names))]
                kinds = ("i8", "i8", "i8", "i4", "u8", "i8", "i8", "i4")
                return pa.RecordBatch.from_arrays([pa.array(c.astype(k).view("i8") if k == "u8" else c.astype(k)) for c, k in zip(cols, kinds, strict=True)], names)

            for doc, doc2, text in zip(stream(batch.column(0)), stream(batch.column(1)), stream(batch.column(2)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for at in range(0, len(raw) - length + 1, STRETCH):
                    part = raw[at : at + STRETCH + length - 1]
                    start, windows, anchor, times = find_runs(np.frombuffer(part, np.uint8), length)
                    digests = b"".join(hashlib.blake2b(part[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + windows + length - 1).tolist(), strict=True))
                    c = np.frombuffer(digests, "<i8").reshape(-1, 2)
                    parts.append((np.full(len(start), doc, "i8"), np.full(len(start), doc2, "i8"), start + at, windows, anchor, c[:, 0], c[:, 1], times))
                    size += len(start)
                    if size > 100_000:
                        yield flush(parts)
                        parts, size = [], 0
            if parts:
                yield flush(parts)
        tidy()

    return texts.mapInArrow(run, "doc long, doc2 long, start long, windows int, a long, c1 long, c2 long, times int")


def equal_strings(data, left, right, length: int):
    """Which of the pairs of places in data start equal strings of ``length`` (8 or more) bytes, all inside data."""
    import numpy as np

    view, alive = eights(data), np.arange(len(left))
    for k in [*range(0, length - 7, 8), length - 8]:
        alive = alive[view[left[alive] + k] == view[right[alive] + k]]
    return alive


def _marks(marked, text_of, start_of, rids):
    """(rid, from, to) of the runs of marked windows; to is the last window's start."""
    import numpy as np

    edge = np.diff(np.concatenate(([0], marked.astype(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    own = text_of[begin]
    return rids[own], begin - start_of[own], end - start_of[own]


def repeated_windows(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """(rid, from, to): windows of the texts (rid, a, text) that occur twice or more among texts of the same anchor."""

    def sort(table):
        import numpy as np
        import pyarrow as pa

        anchors = table.column("a").to_numpy()
        by = np.argsort(anchors, kind="stable")
        rids, raw = table.column("rid").to_numpy(), table.column("text").to_pylist()
        sizes = np.array([len(raw[i]) + 1 for i in by])
        last = np.concatenate((anchors[by][1:] != anchors[by][:-1], [True]))  # of its anchor
        out, first, total = [], 0, 0
        for i in range(len(by)):
            total += sizes[i]
            if last[i] and (i + 1 == len(by) or total + HOT_BYTES > MOST):
                rows = by[first : i + 1]
                data = np.frombuffer(b"".join(raw[r] + b"\0" for r in rows), np.uint8)
                ends = np.cumsum(sizes[first : i + 1])
                starts = ends - sizes[first : i + 1]
                symbols = data.astype(np.int64) + 2
                symbols[ends - 1] = 1
                order = suffix_order(symbols)
                text_of = np.searchsorted(ends, np.arange(len(data)), side="right")
                whole = np.arange(len(data)) + length < ends[text_of]
                order = order[whole[order]]
                same = equal_strings(data, order[:-1], order[1:], length)
                marked = np.zeros(len(data), bool)
                marked[order[same]] = marked[order[same + 1]] = True
                out.append(_marks(marked, text_of, starts, rids[rows]))
                first, total = i + 1, 0
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table([pa.array(cols[0].astype("i8")), pa.array(cols[1].astype("i4")), pa.array(cols[2].astype("i4"))], ["rid", "from", "to"])

    return texts.withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(buckets))).groupBy("bucket").applyInArrow(sort, "rid long, from int, to int")


def window_digests(texts: list[bytes], length: int):
    """(digest, text, place): of each window of the texts, the two halves of 128 bits of blake2b, its text and its start there."""
    import hashlib

    import numpy as np

    n = np.array([len(t) - length + 1 for t in texts])
    raw = b"".join(hashlib.blake2b(t[i : i + length], digest_size=16).digest() for t in texts for i in range(len(t) - length + 1))
    own = np.repeat(np.arange(len(texts)), n)
    return np.frombuffer(raw, "<u8").reshape(-1, 2), own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)


def _distinct_digests(d):
    """Sorted distinct digests, and for each row of d its place among them."""
    import numpy as np

    order = np.lexsort((d[:, 1], d[:, 0]))
    ranked = d[order]
    new = np.concatenate((np.ones(min(1, len(d)), bool), (ranked[1:] != ranked[:-1]).any(1)))
    place = np.empty(len(d), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


def repeated_one_by_one(texts: DataFrame, length: int) -> DataFrame:
    """The same as repeated_windows, from 128 bits of blake2b for each window, for anchors with any number of texts.

    Texts lie in blocks of about BLOCK_BYTES. A block sends its distinct digests, as packed arrays, to the partitions that
    their leading bits name; each partition answers with which of them occur twice or more, in the block's own order. Rows
    are blocks times partitions, or as many as windows if those are fewer; a frequent window is one entry of each block.
    """

    def lay(batches):
        import uuid

        import pyarrow as pa

        def emit(rids, raw):
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([rids], pa.list_(pa.int64())), pa.array([raw], pa.list_(pa.binary()))], ["block", "rids", "texts"])

        rids, raw, size = [], [], 0
        for batch in batches:
            for rid, text in zip(stream(batch.column("rid")), stream(batch.column("text")), strict=True):
                # A long text comes in stretches that share length - 1 bytes; its windows' places count from the stretch.
                for at in range(0, len(text) - length + 1, BLOCK_BYTES):
                    rids += [rid, at]
                    raw.append(text[at : at + BLOCK_BYTES + length - 1])
                    size += len(raw[-1])
                    if size >= BLOCK_BYTES:
                        yield emit(rids, raw)
                        rids, raw, size = [], [], 0
        if raw:
            yield emit(rids, raw)

    blocks = settle(texts.mapInArrow(lay, "block long, rids array<long>, texts array<binary>"), "hot-blocks")
    size = blocks.agg(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.length(t)))).first()[0] or 0
    bits = max(1, (size // BLOCK_BYTES).bit_length())  # of the digest, that name a partition

    def send(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for block, raw in zip(stream(batch.column("block"), 1), stream(batch.column("texts"), 1), strict=True):
                kinds, place = _distinct_digests(window_digests(raw, length)[0])
                twice = np.bincount(place, minlength=len(kinds)) > 1
                some, first = np.unique(kinds[:, 0] >> np.uint64(64 - bits), return_index=True)
                cut = [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(kinds)], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype("i4")), pa.array([block] * len(some), pa.int64()), pa.array([kinds[c].tobytes() for c in cut], pa.binary()), pa.array([twice[c].tobytes() for c in cut], pa.binary())],
                    ["part", "block", "digests", "twice"],
                )

    def meet(table):
        import numpy as np
        import pyarrow as pa

        raw = table.column("digests").to_pylist()
        kinds, place = _distinct_digests(np.frombuffer(b"".join(raw), "<u8").reshape(-1, 2))
        often = np.bincount(place, minlength=len(kinds)) > 1
        np.logical_or.at(often, place, np.frombuffer(b"".join(table.column("twice").to_pylist()), bool))
        ends = np.cumsum([len(r) // 16 for r in raw])
        answer = [often[place[e - len(r) // 16 : e]].tobytes() for r, e in zip(raw, ends.tolist(), strict=True)]
        return pa.table([table.column("part"), table.column("block"), pa.array(answer, pa.binary())], ["part", "block", "often"])

    def mark(key, block, back):
        import numpy as np
        import pyarrow as pa

        rids, raw = block.column("rids")[0].as_py(), block.column("texts")[0].as_py()
        digests, own, at = window_digests(raw, length)
        place = _distinct_digests(digests)[1]
        answers = dict(zip(back.column("part").to_pylist(), back.column("often").to_pylist(), strict=True))
        often = np.frombuffer(b"".join(answers[p] for p in sorted(answers)), bool)
        hit = often[place]
        # A run of repeated windows inside one text is one row.
        begin = hit & np.concatenate(([True], ~hit[:-1] | (own[1:] != own[:-1])))
        end = hit & np.concatenate((~hit[1:] | (own[1:] != own[:-1]), [True]))
        rid, shift = np.array(rids[0::2])[own[begin]], np.array(rids[1::2])[own[begin]]
        return pa.table([pa.array(rid), pa.array((at[begin] + shift).astype("i4")), pa.array((at[end] + shift).astype("i4"))], ["rid", "from", "to"])

    sent = blocks.select("block", "texts").mapInArrow(send, "part int, block long, digests binary, twice binary")
    answers = sent.groupBy("part").applyInArrow(meet, "part int, block long, often binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(mark, "rid long, from int, to int")


def _remade(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with the keys made anew under a leading _: a join then exchanges both sides, and may split a frequent key."""
    return rows.select(*[F.expr(f"{k} ^ cast(0 as bigint)").alias(f"_{k}") for k in keys], *[c for c in rows.columns if c not in keys])


def _same(*keys: str):
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return on


def removed_spans(texts: DataFrame, length: int) -> DataFrame:
    """(doc, doc2, spans array<struct<from, to>>): bytes of the rows (doc, doc2, text) that go, as stretches that may overlap."""
    runs = settle(runs_of(texts, length), "runs")
    again = runs.groupBy("a").agg(F.sum("times").alias("n")).filter("n > 1").select("a")
    again = settle(again, "anchors")
    some = settle(flag_members(runs, ["a"], again, "some").filter("some").drop("some"), "some-runs")

    # One row for each distinct run of an anchor; equal ones are of one length.
    kinds = some.groupBy("a", "c1", "c2").agg(F.count("*").alias("runs"), F.min(F.struct("doc", "doc2", "start")).alias("at"), F.max("times").alias("times"), F.max("windows").alias("windows"))
    kinds = settle(kinds, "run-kinds")
    anchors = kinds.groupBy("a").agg(F.count("*").alias("kinds"), F.sum(F.col("windows") + length - 1).alias("bytes"))
    open_ = kinds.join(_remade(anchors, "a"), _same("a")).filter("kinds > 1 or (runs = 1 and times > 1)")
    hot = (F.col("kinds") > HOT_TEXTS) | (F.col("bytes") > HOT_BYTES)
    wanted = settle(open_.select("at.*", "windows", "a", (F.col("runs") == 1).alias("alone"), hot.alias("hot"), F.monotonically_increasing_id().alias("rid")), "wanted")

    whole = some.join(_remade(kinds.filter("runs > 1").select("a", "c1", "c2"), "a", "c1", "c2"), _same("a", "c1", "c2"))
    whole = whole.select(*DOC, F.col("start").alias("from"), (F.col("start") + F.col("windows") + length - 1).alias("to"))

    def cut(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in slices(whole)):
            cols = ([], [], [], [])
            for text, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for x in items:
                    for own, v in zip(cols, (x["rid"], x["a"], x["hot"], data[x["start"] : x["start"] + x["windows"] + length - 1]), strict=True):
                        own.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["rid", "a", "hot", "text"])

    lists = wanted.groupBy(*DOC).agg(F.collect_list(F.struct("rid", "a", "hot", "start", "windows")).alias("items"))  # as many as a document has runs
    near = flag_members(texts, list(DOC), wanted.select(*DOC).distinct(), "some").filter("some").select(*DOC, "text")
    parts = near.dropDuplicates(list(DOC)).join(_remade(lists, *DOC), _same(*DOC)).select("text", "items").mapInArrow(cut, "rid long, a long, hot boolean, text binary")
    parts = settle(parts, "run-texts")
    size = parts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = repeated_windows(parts.filter("not hot").select("rid", "a", "text"), length, max(12, size // 1_000_000 + 1))
    found = found.unionByName(repeated_one_by_one(parts.filter("hot").select("rid", "text"), length))
    alone = wanted.filter("alone").select("rid", *DOC, "start")
    edges = found.join(_remade(alone, "rid"), _same("rid")).select(*DOC, (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to") + length).alias("to"))
    # A set: rows that repeat id and text have the same stretches.
    return whole.unionByName(edges).groupBy(*DOC).agg(F.collect_set(F.struct("from", "to")).alias("spans"))


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal stretches covered by the spans, in order."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((x["from"], x["to"]) for x in spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary), one row per row of docs.

    Texts are UTF-8 bytes, null as empty; strings never cross documents and are judged on the input. A byte goes if a
    string of ``length`` bytes (at least 32) over it starts anywhere else too, in the same document or in another
    row, overlapping or not; so all copies of a long text go. Null and repeated ids are rows of their own; columns
    other than id and text are not read. An empty table gives an empty result. Texts of any length are worked through
    in stretches; a task holds a few copies of one text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    # Rows that repeat id and text share their spans.
    rows = rows.withColumn("doc", F.xxhash64("doc_id", "text")).withColumn("doc2", F.xxhash64(F.lit(1), "text", "doc_id"))
    with temporary() as tables:
        long = rows.filter(F.octet_length("text") >= length).select(*DOC, "text")
        spans = tables.keep(settle(removed_spans(long, length), "spans"))

    def clean(batches):
        import hashlib

        import pyarrow as pa

        for batch in (part for whole in batches for part in slices(whole)):
            cols = ([], [], [], [], [])
            for text, items in zip(stream(batch.column(1)), stream(batch.column(2)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                gone = merged(items or [])
                kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(a for a, _ in gone), len(data)], strict=True)) if gone else data
                for own, v in zip(cols, (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    own.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        tidy()

    flagged = flag_members(rows, list(DOC), spans.select(*DOC), "some")
    clear = flagged.filter("not some").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    rest = flagged.filter("some").join(_remade(spans, *DOC), _same(*DOC), "left").select("doc_id", "text", "spans")
    return clear.unionByName(rest).mapInArrow(clean, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op4_repeats(spark, sf_dir):
    return settle(remove_repeats(documents(spark, sf_dir)).drop("kept"), "repeats")
