"""Language-model scores by stupid backoff, with counts gathered from the whole corpus.

Documents are laid into blocks. Each block's distinct n-grams go, with their counts, to the partition their hash
names; there the counts of all blocks meet in one table, which is joined to the n-grams again, and the totals travel
back to the blocks, in the order of their own n-grams. A block then explodes its documents into n-grams, looks
their totals up, and sums each document's scores. A document's own occurrences are taken off every count, so a text
is judged by the rest of the corpus. N-grams move as packed arrays: a frequent one is one entry per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.columns import col
from stratum.llm.scratch import documents, settle
from stratum.llm.words import distinct, mix64, word_hashes
from stratum.llm.workers import stream, tidy

BACKOFF = 0.4
UNSEEN = 0.5  # count of a word that no other document has
PART_BYTES = 8_000_000  # of text for each partition of the counts


def ngram_keys(doc, word, order: int) -> list:
    """For n = 1 .. order: (positions of the last word, keys) of the n-grams inside one document."""
    import numpy as np

    out, weight = [], mix64(np.arange(1, order + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    for n in range(1, order + 1):
        stop = len(word) - n + 1
        if stop <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
            continue
        h = np.full(stop, n, np.uint64)
        for k in range(n):
            h += word[k : k + stop] * weight[k]
        inside = np.flatnonzero(doc[:stop] == doc[n - 1 :])
        out.append((inside + n - 1, mix64(h[inside])))
    return out


def _pack_keys(keys, bits: int) -> bytes:
    """Sorted keys without their leading bytes, which the partition's number (of ``bits`` bits) gives: none is lost."""
    import numpy as np

    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 - bits // 8]).tobytes()


def _unpack_keys(data: bytes, bits: int, part: int):
    import numpy as np

    kept = 8 - bits // 8
    wide = np.zeros((len(data) // kept, 8), np.uint8)
    wide[:, :kept] = np.frombuffer(data, np.uint8).reshape(-1, kept)
    lead = part >> (bits % 8) << (64 - 8 * (bits // 8))  # the part's whole bytes
    return wide.view("<u8").reshape(-1) | np.uint64(lead)


def _pack_counts(n) -> bytes:
    """Counts as bytes; those of 255 and more as 255, followed in a tail by eight bytes each."""
    import numpy as np

    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes()


def _unpack_counts(data: bytes, size: int):
    import numpy as np

    n = np.frombuffer(data, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(data, "<i8", offset=size)
    return n


def _lay_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, words, ids, lengths, data): texts of about block_bytes together, compressed. A block never crosses tasks."""

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        import zstandard

        def emit(ids, raw):
            words = len(word_hashes(raw)[1])
            number = uuid.uuid4().int >> 65
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([words], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.array([len(r) for r in raw], "<i8").tobytes()], pa.binary()), pa.array([zstandard.compress(b"".join(raw))], pa.binary())],
                ["block", "words", "ids", "lengths", "data"],
            )

        ids, raw, size = [], [], 0
        for batch in batches:
            for i, t in zip(stream(batch.column(0)), stream(batch.column(1)), strict=True):
                ids.append(i)
                raw.append((t or "").encode("utf-8", "surrogatepass"))
                size += len(raw[-1])
                if size >= block_bytes:
                    yield emit(ids, raw)
                    ids, raw, size = [], [], 0
        if ids:
            yield emit(ids, raw)
        tidy()

    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    return rows.mapInArrow(run, "block long, words long, ids array<long>, lengths binary, data binary")


def _open(lengths: bytes, data: bytes) -> list[bytes]:
    import numpy as np
    import zstandard

    whole, cut = zstandard.decompress(data), np.concatenate(([0], np.cumsum(np.frombuffer(lengths, "<i8"))))
    return [whole[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def score_documents(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4_000_000) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score), one row per row of docs.

    log_score sums, over a document's words, the log of count(n-gram) / count(its first n - 1 words) for the longest
    n-gram, up to ``order``, that other documents hold too, times 0.4 for each order backed off from; a word alone is
    divided by all words of the others, and one that no other document has counts 0.5. Counts leave out the
    document's own occurrences; a copy in another row counts as another document. A document without words has
    n_tokens 0, log_score 0 and a null mean. Null and repeated ids are scored row by row; columns other than id and
    text are not read. An empty table gives an empty result. N-grams are told apart by 64 bits at any size of the
    corpus. Partitions grow with the corpus; a block sends a row to those that it has n-grams for, so rows never
    outnumber n-grams. A task holds one block: some 4 MB of text, or one text that is longer.
    """
    blocks = settle(_lay_blocks(docs, id_col, text_col, block_bytes), "blocks")
    words = blocks.agg(F.sum("words")).first()[0] or 0
    size = docs.agg(F.sum(F.octet_length(col(text_col)))).first()[0] or 0
    bits = max(8, (size // PART_BYTES).bit_length())  # of the hash, that name a partition

    def keys_of(raw):
        import numpy as np

        doc, word = word_hashes(raw)
        grams = ngram_keys(doc, word, order)
        return doc, grams, np.concatenate([k for _, k in grams])

    def send(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for number, lengths, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, n = distinct(keys_of(_open(lengths, data))[2])
                some, first = np.unique(keys >> np.uint64(64 - bits), return_index=True)
                cut = [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype("i4")), pa.array([number] * len(some), pa.int64()), pa.array([_pack_keys(keys[c], bits) for c in cut], pa.binary()), pa.array([_pack_counts(n[c]) for c in cut], pa.binary())],
                    ["part", "block", "keys", "counts"],
                )

    def count(table):
        import numpy as np
        import pyarrow as pa

        part, numbers = table.column("part")[0], table.column("block")
        lists = [_unpack_keys(k, bits, part.as_py()) for k in table.column("keys").to_pylist()]
        own = np.concatenate([_unpack_counts(c, len(k)) for c, k in zip(table.column("counts").to_pylist(), lists, strict=True)])
        flat = np.concatenate(lists)
        order_ = np.argsort(flat, kind="stable")
        ranked = flat[order_]
        at = np.flatnonzero(np.concatenate((np.ones(min(1, len(ranked)), bool), ranked[1:] != ranked[:-1])))
        total = np.zeros(len(flat), np.int64)
        total[order_] = np.repeat(np.add.reduceat(own[order_], at), np.diff(np.concatenate((at, [len(ranked)])))) if len(at) else 0
        counts, begin = [], 0
        for k in lists:
            mine = slice(begin, begin + len(k))
            counts.append(_pack_counts(np.where(total[mine] > own[mine], total[mine], 0)))
            begin += len(k)
        return pa.table([pa.array([part.as_py()] * len(lists), pa.int32()), numbers, pa.array(counts, pa.binary())], ["part", "block", "counts"])

    kind = "part int, block long, keys binary, counts binary"
    sent = blocks.select("block", "lengths", "data").mapInArrow(send, kind)
    totals = sent.groupBy("part").applyInArrow(count, "part int, block long, counts binary")

    def score(key, block, back):
        import numpy as np
        import pyarrow as pa

        ids = block.column("ids")[0].as_py()
        doc, grams, every = keys_of(_open(block.column("lengths")[0].as_py(), block.column("data")[0].as_py()))
        keys, total = distinct(every)
        for part, c in zip(back.column("part").to_pylist(), back.column("counts").to_pylist(), strict=True):
            a, b = np.searchsorted(keys >> np.uint64(64 - bits), np.array([part, part + 1], np.uint64))
            more = _unpack_counts(c, b - a)  # in the order of the block's own keys; 0 where no other block has the key
            total[a:b] = np.where(more > 0, more, total[a:b])
        n_docs = len(ids)
        tokens = np.bincount(doc, minlength=n_docs)
        rest = np.maximum(1, words - tokens)[doc]
        others = []  # by n: at each position, occurrences of its n-gram in other documents
        for position, k in grams:
            mark = np.full(len(doc), -1, np.int64)
            spot = np.searchsorted(keys, k)
            pair = doc[position].astype(np.int64) * len(keys) + spot
            _, where, times = np.unique(pair, return_inverse=True, return_counts=True)
            mark[position] = total[spot] - times[where]
            others.append(mark)
        value = np.log(np.maximum(others[0], UNSEEN) / rest)
        for n in range(2, order + 1):
            top = others[n - 1]
            below = np.concatenate(([0], others[n - 2][:-1]))  # the n-gram without its last word ends one word before
            hit = top > 0
            value = np.where(hit, np.log(np.maximum(top, 1) / np.maximum(below, 1)), np.where(top >= 0, value + np.log(BACKOFF), value))
        sums = np.bincount(doc, value, n_docs)
        mean = [s / t if t else None for s, t in zip(sums.tolist(), tokens.tolist(), strict=True)]
        return pa.table([pa.array(ids, pa.int64()), pa.array(tokens.astype("i8")), pa.array(sums), pa.array(mean, pa.float64())], ["doc_id", "n_tokens", "log_score", "mean_log_score"])

    return blocks.select("block", "ids", "lengths", "data").groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, log_score double, mean_log_score double")


def op3_lm_score(spark, sf_dir):
    out = score_documents(documents(spark, sf_dir))
    return out.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT * FROM (SELECT doc_id, unnest(w) AS w2, unnest(list_prepend(NULL, w[:-2])) AS w1 FROM d) WHERE w2 IS NOT NULL),
n AS (SELECT count(*) AS n FROM p),
u AS (SELECT w2 AS w, count(*) AS c FROM p GROUP BY 1), ud AS (SELECT doc_id, w2 AS w, count(*) AS c FROM p GROUP BY 1, 2),
b AS (SELECT w1, w2, count(*) AS c FROM p WHERE w1 IS NOT NULL GROUP BY 1, 2), bd AS (SELECT doc_id, w1, w2, count(*) AS c FROM p WHERE w1 IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT doc_id, count(*) AS m FROM p GROUP BY 1),
o AS (SELECT p.doc_id, m.m, p.w1, u.c - ud.c AS c1, b.c - bd.c AS c2, x.c - xd.c AS below, n.n - m.m AS rest
  FROM p JOIN n ON true JOIN m USING (doc_id) JOIN u ON u.w = p.w2 JOIN ud ON ud.doc_id = p.doc_id AND ud.w = p.w2
  LEFT JOIN b ON b.w1 = p.w1 AND b.w2 = p.w2 LEFT JOIN bd ON bd.doc_id = p.doc_id AND bd.w1 = p.w1 AND bd.w2 = p.w2
  LEFT JOIN u x ON x.w = p.w1 LEFT JOIN ud xd ON xd.doc_id = p.doc_id AND xd.w = p.w1),
s AS (SELECT doc_id, any_value(m) AS m, sum(CASE WHEN c2 > 0 THEN ln(c2 / greatest(below, 1)) ELSE ln(greatest(c1, 0.5) / greatest(rest, 1)) + CASE WHEN w1 IS NULL THEN 0 ELSE ln(0.4) END END) AS t FROM o GROUP BY 1)
SELECT d.doc_id, coalesce(m, 0)::BIGINT AS n_tokens, round(coalesce(t, 0.0), 4) AS log_score, round(t / m, 6) AS mean_log_score FROM d LEFT JOIN s USING (doc_id)
"""
