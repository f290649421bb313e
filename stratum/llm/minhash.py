"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets and union-find grouping.

Documents with equal shingle sets (by 128 bits and more of digest) form a class, and only a class's smallest id goes on.
In a bucket of the banding, every member is first checked against one centre, the member with most bucket mates, and
while buckets stay open with many members outside their largest component, against others; this joins large groups of
copies in a number of checks linear in their size. Buckets whose members are then still in several components have
their remaining pairs across components compared by signature, inside neighbouring size classes: members of the largest
component against all others, and the others among themselves, in blocks. The likely ones are checked on full sets of
words, byte by byte. Between different components, a link that the banding can see is lost only if the pair's signatures
agree in fewer than alike(numerator) bytes: with chance 5e-8 for a pair at 0.85, 3e-8 at 0.8 (binomial over the slots,
byte collisions included).
"""

from __future__ import annotations

from functools import cache
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.components import components
from stratum.llm.membership import flag_members
from stratum.llm.columns import col, opened, whole
from stratum.llm.scratch import documents, settle, temporary
from stratum.llm.words import mix64, named_shingles, span_hashes, stretches, word_spans
from stratum.llm.workers import slices, tidy

WORDS = 5
LENGTH = 80  # signature
MISSED, UNLIKE = 5e-7, 1e-7  # greatest chances that a pair at the threshold misses all bands, or fails the signature check
LARGE_BUCKET = 64  # members outside a bucket's largest component that call for another turn of stars before pairs are compared
STAR_TURNS = 3
STRETCH = 4_000_000  # bytes of a long text that are worked through at once
ELEMENTS = 500_000  # of a set that are ranked at once


def band_rows(numerator: int) -> int:
    """Slots of a band: the most with which a pair at the threshold shares some band, but for a chance of MISSED."""
    return max((r for r in range(1, LENGTH + 1) if (1 - (numerator / 100) ** r) ** (LENGTH // r) <= MISSED), default=1)


@cache
def alike(numerator: int) -> int:
    """Equal signature bytes of a pair worth a full check: a pair at the threshold has fewer with a chance up to UNLIKE."""
    ratio, fewer, k = numerator / 100, 0.0, 0
    while k < LENGTH:
        fewer += comb(LENGTH, k) * ratio**k * (1 - ratio) ** (LENGTH - k)
        if fewer > UNLIKE:
            break
        k += 1
    return k


def _shingles(raw: list[bytes]):
    """(doc, hash, second hash) arrays sorted by doc and hash: the distinct shingles of each text."""
    import numpy as np

    data, doc, start, end = word_spans(raw)
    words = span_hashes(data, start, end), span_hashes(data, start, end, 1)
    count = np.bincount(doc, minlength=len(raw))
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    weight = mix64(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    docs, hashes = [], ([], [])
    if len(doc) >= WORDS:
        stop = len(doc) - WORDS + 1
        inside = doc[:stop] == doc[WORDS - 1 :]
        docs.append(doc[:stop][inside])
        for word, out in zip(words, hashes, strict=True):
            h = np.full(stop, WORDS, np.uint64)
            for k in range(WORDS):
                h += word[k : k + stop] * weight[k]
            out.append(mix64(h[inside]))
    for n in range(1, WORDS):
        few = np.flatnonzero(count == n)
        docs.append(few)
        for word, out in zip(words, hashes, strict=True):
            h = np.full(len(few), n, np.uint64)
            for k in range(n):
                h += word[first[few] + k] * weight[k]
            out.append(mix64(h))
    return _distinct(np.concatenate(docs).astype(np.int64), *map(np.concatenate, hashes))


def _distinct(doc, h, g):
    import numpy as np

    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    return doc[new], h[new], g[order][new]


def shingles(texts: list):
    """_shingles of texts, of which long ones are worked through in stretches: memory grows with their distinct shingles."""
    import numpy as np

    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    long = [i for i, r in enumerate(raw) if len(r) > STRETCH]
    if not long:
        return _shingles(raw)
    parts = [_shingles([b"" if len(r) > STRETCH else r for r in raw])]
    for i in long:
        held = parts[0][0][:0], parts[0][1][:0], parts[0][2][:0]
        for part in stretches(raw[i], STRETCH, WORDS - 1):
            held = _distinct(*map(np.concatenate, zip(held, _shingles([part]), strict=True)))
        parts.append((held[0] + i, *held[1:]))
        raw[i] = b""
    return _distinct(*map(np.concatenate, zip(*parts, strict=True)))


def signatures(doc, h, n_docs: int, length: int = LENGTH):
    """SuperMinHash of each document, uint64 (n_docs, length); rows of documents without elements stay at the maximum.

    Element and level give a rank within the level and the level's place in the element's own random permutation of
    the slots; a slot keeps the least (level, rank). After level j a document is finished if its every slot holds a
    level up to j, as later levels could only bring more. The signature of a large set is the least of its parts'.
    """
    import numpy as np

    out = np.full(n_docs * length, np.iinfo(np.uint64).max, np.uint64)
    if len(h) > ELEMENTS:
        out = out.reshape(n_docs, length)
        for a in range(0, len(h), ELEMENTS):
            lo, hi = int(doc[a]), int(doc[min(a + ELEMENTS, len(h)) - 1]) + 1
            part = signatures(doc[a : a + ELEMENTS] - lo, h[a : a + ELEMENTS], hi - lo, length)
            out[lo:hi] = np.minimum(out[lo:hi], part)
        return out
    seats = None
    for level in range(length):
        if not len(h):
            break
        draw = mix64(h + np.uint64(0xA0761D6478BD642F * (2 * level + 1) & (1 << 64) - 1))
        value = np.uint64(level << 52) | (draw >> np.uint64(12))
        pick = level + (mix64(draw) % np.uint64(length - level)).astype(np.int64)
        if level == 0:
            slot = pick
        else:
            at = np.arange(len(h))
            slot = seats[at, pick].astype(np.int64)
            seats[at, pick] = seats[at, level]
        np.minimum.at(out, doc * length + slot, value)
        present = np.unique(doc)
        worst = out.reshape(n_docs, length)[present].max(1)
        going = np.zeros(n_docs, bool)
        going[present[worst >= np.uint64((level + 1) << 52)]] = True
        keep = going[doc]
        if level == 0:
            doc, h, pick = doc[keep], h[keep], pick[keep]
            seats = np.tile(np.arange(length, dtype=np.uint8), (len(h), 1))
            seats[np.arange(len(h)), pick] = 0
        elif not keep.all():
            doc, h, seats = doc[keep], h[keep], seats[keep]
    return out.reshape(n_docs, length)


def _chunks(texts: list, size: int = 1_000_000):
    """Index ranges of texts of about ``size`` characters."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def sign(docs: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest, bands array<long>, sig binary) of each row, in bands of ``rows``; empty sets have null digest, bands and sig."""
    n_bands = LENGTH // rows

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                doc, h, g = shingles(texts[a:b])
                n = np.bincount(doc, minlength=b - a)
                sig = signatures(doc, h, b - a)
                mixed = mix64(sig)
                keys = np.zeros((b - a, n_bands), np.uint64)
                for r in range(rows):
                    keys = mix64(keys * np.uint64(0x9FB21C651E98DF25) + mixed[:, r : n_bands * rows : rows])
                keys = mix64(keys + np.arange(n_bands, dtype=np.uint64)).astype(np.int64)
                low = (mixed >> np.uint64(56)).astype(np.uint8)
                cut = np.concatenate(([0], np.cumsum(n)))
                full = [bool(x) for x in n]
                second = np.zeros(b - a + 1, np.uint64)  # sums of the second hashes: sets with equal first ones must agree here too
                np.add.at(second, doc, g)
                digest = [hashlib.blake2b(h[cut[i] : cut[i + 1]], digest_size=24, salt=second[i].tobytes()).digest() if full[i] else None for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype("i8")), pa.array(digest, pa.binary()), pa.array([keys[i].tolist() if full[i] else None for i in range(b - a)], pa.list_(pa.int64())), pa.array([low[i].tobytes() if full[i] else None for i in range(b - a)], pa.binary())],
                    ["id", "n", "digest", "bands", "sig"],
                )
        tidy()

    given = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    return given.mapInArrow(run, "id long, n long, digest binary, bands array<long>, sig binary")


def verify(pairs: DataFrame, texts: DataFrame, numerator: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets meet 100 * intersection >= numerator * union. texts: (id, text).

    The sets are made of the words themselves, not of hashes.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (part for whole in batches for part in slices(whole)):
            us, vs, left, right = (c.to_pylist() for c in batch.columns)
            keep, begin = [], 0
            while begin < len(us):
                # Sets of the texts of some pairs at a time, each text once.
                stop, size, want = begin, 0, {}
                while stop < len(us) and size < 1_000_000:
                    for i, t in ((us[stop], left[stop]), (vs[stop], right[stop])):
                        if i not in want:
                            want[i] = t
                            size += len(t)
                    stop += 1
                ids = list(want)
                doc, name = named_shingles([t.encode("utf-8", "surrogatepass") for t in want.values()], WORDS)
                cut = np.searchsorted(doc, np.arange(len(ids) + 1))
                known = {i: name[cut[k] : cut[k + 1]] for k, i in enumerate(ids)}
                for p in range(begin, stop):
                    a, b = known[us[p]], known[vs[p]]
                    small, large = (a, b) if len(a) < len(b) else (b, a)
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                    if 100 * both >= numerator * max(1, len(a) + len(b) - both):
                        keep.append(p)
                begin = stop
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["u", "v"])
        tidy()

    t = texts.select(F.col("id").alias("own"), "text")
    both = pairs.select("u", "v").join(t, F.col("u") == F.col("own")).select("u", "v", F.col("text").alias("left"))
    both = both.join(t, F.col("v") == F.col("own")).select("u", "v", "left", "text")
    return both.mapInArrow(run, "u long, v long")


def _centres(held: DataFrame, turn: int) -> DataFrame:
    """(k, centre, centre_comp) of each bucket: its member of greatest weight, in later turns among a third of them."""
    place = F.col("weight") * (1 << 20) + F.xxhash64("id", F.lit(turn)).bitwiseAND(F.lit((1 << 20) - 1))
    if turn:
        place = F.when(F.pmod(F.xxhash64("id", F.lit(-turn)), F.lit(3)) == 0, place).otherwise(place - (1 << 61))
    best = held.withColumn("place", place).groupBy("key").agg(F.max_by("id", "place").alias("centre"), F.max_by("comp", "place").alias("centre_comp"))
    return best.select(F.expr("key ^ cast(0 as bigint)").alias("k"), "centre", "centre_comp")


def _likely(left: str, right: str, numerator: int):
    """Whether two classes can be linked: by set sizes (exactly), and by equal signature bytes."""
    sizes = F.least(f"{left}.n", f"{right}.n") * 100 >= F.greatest(f"{left}.n", f"{right}.n") * numerator
    a, b = F.hex(f"{left}.sig"), F.hex(f"{right}.sig")
    same = F.aggregate(F.sequence(F.lit(0), F.lit(LENGTH - 1)), F.lit(0), lambda s, i: s + F.when(F.substring(a, 2 * i + 1, F.lit(2)) == F.substring(b, 2 * i + 1, F.lit(2)), 1).otherwise(0))
    return sizes & (same >= alike(numerator))


def equal_bytes(a, b):
    """How many bytes agree in each pair of rows of two uint64 matrices."""
    import numpy as np

    low, high = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
    x = a ^ b
    return 8 * x.shape[1] - np.bitwise_count((((x & low) + low) | x) & high).sum(1, dtype=np.int64)


def _likely_partners(table, key: int, i: int, j: int, numerator: int):
    """(a, b): rows of a group that are likely linked and in different components, by sizes, ``most`` and signature.

    ``own`` marks rows of the group's size class; of the others, one class lower, only pairs with an own row count.
    With i below 0, members of the bucket's largest component (``main``) meet the others; else i and j tell the two
    blocks of the others that meet here. ``most`` bounds a row's overlap with any other component, so a pair with too
    small a bound can't be linked. A pair that meets in several buckets is given in the one of its first equal band.
    """
    import numpy as np

    own, main = (table.column(c).to_numpy(zero_copy_only=False) for c in ("own", "main"))
    ids, n, comp, most, block = (table.column(c).to_numpy() for c in ("id", "n", "comp", "most", "block"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u8").reshape(-1, LENGTH // 8)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(sig), -1)
    rows, out = np.flatnonzero(own), [(np.zeros(0, np.int64),) * 2]
    step = max(1, 200_000 // len(ids))
    for s in range(0, len(rows), step):
        r = rows[s : s + step][:, None]
        ok = (comp != comp[r]) & (100 * np.minimum(n, n[r]) >= numerator * np.maximum(n, n[r])) & (~own | (ids > ids[r]))
        ok &= (100 + numerator) * np.minimum(most, most[r]) >= numerator * (n + n[r])
        ok &= (main != main[r]) if i < 0 else ((block == j) & (block[r] == i)) | ((block == i) & (block[r] == j))
        a, b = np.nonzero(ok)
        a = rows[s + a]
        for c in range(0, len(a), 50_000):
            p, q = a[c : c + 50_000], b[c : c + 50_000]
            fit = equal_bytes(sig[p], sig[q]) >= alike(numerator)
            p, q = p[fit], q[fit]
            first = (bands[p] == bands[q]).argmax(1)
            here = bands[p, first] == key
            out.append((p[here], q[here]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def dealt_pairs(held: DataFrame, props: DataFrame, numerator: int, block: int, tasks: int) -> DataFrame:
    """The members of open buckets, dealt to the groups (key, size_class, i, j) in which their pairs meet, over ``tasks`` tasks.

    held: (key, id, comp); props: (id, n, most, sig, bands). With m members in the bucket's largest component and r others,
    blocks of the one meet blocks of the others, and these each other: r * (2 * m + r) / block rows, and no group has more
    than two blocks.
    """
    counts = held.groupBy("key", "comp").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("key").agg(F.max_by("comp", F.struct(F.col("c"), -F.col("comp"))).alias("largest"), F.max("c").alias("m"), F.sum("c").alias("all"))
    sizes = sizes.select(F.expr("key ^ cast(0 as bigint)").alias("k"), "largest", F.ceil(F.col("m") / block).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("m")) / block).cast("int").alias("others"))
    rows = held.join(sizes, F.col("key") == F.col("k")).withColumn("main", F.col("comp") == F.col("largest"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    meets_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda b: F.struct((-1 - b).alias("i"), F.col("block").alias("j")))
    meets_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda b: F.struct((-1 - F.col("block")).alias("i"), b.alias("j")))
    meets_rest = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("i"), F.greatest(b, F.col("block")).alias("j")))
    rows = rows.withColumn("to", F.explode(F.when(F.col("main"), meets_others).otherwise(F.concat(meets_main, meets_rest))))
    rows = rows.select("key", "id", "comp", "main", "block", "to.i", "to.j").join(props.withColumnRenamed("id", "own_id"), F.col("id") == F.col("own_id"))
    # Sizes of a pair differ by the ratio at most, so both are of one class, or of neighbouring ones.
    rows = rows.withColumn("class", F.floor(F.log("n") / -F.log(F.lit(numerator / 100)) + 1e-9).cast("int")).withColumn("g", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.select("key", (F.col("class") + F.col("g")).alias("size_class"), "i", "j", (F.col("g") == 0).alias("own"), "main", "block", "id", "n", "most", "comp", "sig", "bands")
    return rows.repartition(tasks, "key", "size_class", "i", "j")  # by rows: adaptive execution would pack groups by their few bytes


def likely_members(rows: DataFrame, numerator: int) -> DataFrame:
    """The ids of rows that have a likely partner in their group."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        pairs = _likely_partners(table, key[0].as_py(), key[2].as_py(), key[3].as_py(), numerator)
        return pa.table([pa.array(np.unique(table.column("id").to_numpy()[np.concatenate(pairs)]))], ["id"])

    return rows.groupBy("key", "size_class", "i", "j").applyInArrow(run, "id long").distinct()


def close_pairs(rows: DataFrame, numerator: int) -> DataFrame:
    """The likely pairs (u, v), u < v, of each group of rows."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        a, b = (table.column("id").to_numpy()[x] for x in _likely_partners(table, key[0].as_py(), key[2].as_py(), key[3].as_py(), numerator))
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

    return rows.groupBy("key", "size_class", "i", "j").applyInArrow(run, "u long, v long")


def foreign_overlap(texts: DataFrame, comps: DataFrame) -> DataFrame:
    """(own, most): of each text's shingles, how many occur in a text of another component. comps: (id, comp)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (part for whole in batches for part in slices(whole)):
            ids, comp, raw = (c.to_numpy(zero_copy_only=False) if k < 2 else c.to_pylist() for k, c in enumerate(batch.columns))
            for a, b in _chunks(raw):
                doc, h, _ = shingles(raw[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[a:b][doc]), pa.array(comp[a:b][doc])], ["h", "id", "comp"])

    given = comps.select(F.col("id").alias("own"), "comp")
    each = settle(texts.join(given, F.col("id") == F.col("own")).select("id", "comp", "text").mapInArrow(run, "h long, id long, comp long"), "open-shingles")
    wide = each.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select(F.expr("h ^ cast(0 as bigint)").alias("again"))
    return each.join(wide, F.col("h") == F.col("again")).groupBy("id").agg(F.count("*").alias("most")).select(F.col("id").alias("own"), "most")


def _star_turns(members: DataFrame, texts: DataFrame, props: DataFrame, numerator: int):
    """(links, groups, held): links found from the buckets' centres, components by them, and the members of buckets still open.

    A bucket whose members are in one component stays so, so each turn looks only at what the turn before left open, and
    turns after the first only at buckets with many members outside their largest component.
    """
    links, held, large = None, members.withColumn("comp", F.col("id")), None
    for turn in range(STAR_TURNS):
        at = held if large is None else held.join(large, F.col("key") == F.col("k")).select(*held.columns)
        centred = at.join(_centres(at, turn), F.col("key") == F.col("k")).filter("comp <> centre_comp")
        stars = centred.select(F.least("id", "centre").alias("u"), F.greatest("id", "centre").alias("v")).distinct()
        stars = stars.join(props.alias("a"), F.col("u") == F.col("a.id")).join(props.alias("b"), F.col("v") == F.col("b.id")).filter(_likely("a", "b", numerator)).select("u", "v")
        new = settle(verify(stars, texts, numerator), f"links-{turn}")
        if turn and not new.limit(1).count():
            break
        links = new if links is None else links.unionByName(new)
        groups = components(links)
        now = held.drop("comp").join(groups, F.col("id") == F.col("node"), "left").select("key", "id", "weight", F.coalesce("component", "id").alias("comp"))
        apart = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select(F.expr("key ^ cast(0 as bigint)").alias("k"))
        held = settle(now.join(apart, F.col("key") == F.col("k")).select("key", "id", "weight", "comp"), f"open-{turn}")
        outside = held.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg((F.sum("c") - F.max("c")).alias("c"))
        large = settle(outside.filter(F.col("c") > LARGE_BUCKET).select(F.expr("key ^ cast(0 as bigint)").alias("k")), f"large-{turn}")
        if not large.limit(1).count():
            break
    return links, groups, held


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numerator: int = 85, block: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs.

    Words are runs of non-white-space, A-Z lower-cased; a set holds the distinct 5-word shingles, or the whole
    sequence if it is shorter. Documents are linked if 100 * intersection >= numerator * union. A null, empty or
    blank text has an empty set and is linked with nothing. Rows that share an id are one node, each with its own
    set's size; a row with a null id is linked with nothing, has a null component and is kept. An empty table gives
    an empty result. Columns other than id and text are not read. ``block`` bounds the rows a task compares at once.
    Texts of any length are worked through in stretches: memory grows with a text's distinct shingles.
    """
    with temporary() as tables:
        signed = tables.keep(settle(sign(docs, band_rows(numerator), id_col, text_col), "signed"))
        able = signed.filter("id is not null and n > 0")
        classes = able.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        classes = tables.keep(settle(classes, "classes"))
        banded = classes.select(F.explode("bands").alias("key"), "id")
        shared = banded.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1").select(F.expr("key ^ cast(0 as bigint)").alias("k"), "many")
        members = settle(banded.join(shared, F.col("key") == F.col("k")).select("key", "id", "many"), "members")
        # How many bucket mates a member has in all: high for the middle of a group, which most others are close to.
        weights = members.groupBy("id").agg(F.sum("many").alias("weight")).select(F.col("id").alias("own"), "weight")
        members = settle(members.join(weights, F.col("id") == F.col("own")).select("key", "id", "weight"), "weighted")

        rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).filter("id is not null and text is not null")
        texts = settle(flag_members(rows, ["id"], members.select("id").distinct(), "some").filter("some").select("id", "text"), "texts")
        links, groups, held = _star_turns(members, texts, classes.select("id", "n", "sig"), numerator)

        tasks = max(1, held.count() // 1000)
        props = classes.select("id", "n", "sig", "bands")
        dealt = dealt_pairs(held, props.withColumn("most", F.col("n")), numerator, block, tasks)
        # Texts that share a long passage look alike and aren't: what a text shares with other components bounds its links.
        likely = settle(likely_members(dealt, numerator), "likely")
        comps = likely.join(held.select(F.col("id").alias("own"), "comp").distinct(), F.col("id") == F.col("own")).select("id", "comp")
        most = settle(foreign_overlap(texts, comps), "overlaps")
        able_to = held.join(most, F.col("id") == F.col("own")).join(classes.select(F.col("id").alias("head"), "n"), F.col("id") == F.col("head"))
        able_to = able_to.filter(F.col("most") * 100 >= F.col("n") * numerator).select("key", "id", "comp")
        dealt = dealt_pairs(able_to, props.join(most, F.col("id") == F.col("own")).drop("own"), numerator, block, tasks)
        more = settle(verify(close_pairs(dealt, numerator), texts, numerator), "more-links")
        if more.limit(1).count():
            groups = components(links.unionByName(more))
        groups = tables.keep(settle(groups, "components"))

        cls = classes.select(F.concat(F.col("digest"), F.lit(b"")).alias("d"), F.col("id").alias("head"))
        placed = cls.join(groups, F.col("head") == F.col("node"), "left").select("d", F.coalesce("component", "head").alias("comp"))
        # Rows that share an id and differ in text are one node: its component is the smallest of its rows' components.
        twice = able.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").limit(1).count()
        if twice:
            nodes = able.join(placed, F.col("digest") == F.col("d")).select("id", "comp")
            joined = nodes.filter("id <> comp").select(F.greatest("id", "comp").alias("u"), F.least("id", "comp").alias("v")).distinct()
            joined = tables.keep(settle(components(settle(joined, "shared-ids")), "whole"))
    if twice:
        out = signed.join(joined, F.col("id") == F.col("node"), "left")
        out = out.select("id", "n", F.coalesce("component", "id").alias("component_id"))
    else:
        out = signed.join(placed, F.col("digest") == F.col("d"), "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs' columns and rows, without those that near_duplicates doesn't keep. Rows that surely stay aren't shuffled."""
    with temporary() as tables:
        gone = tables.keep(settle(near_duplicates(docs, id_col, **options).filter("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone"))
    flagged = flag_members(docs.select(whole(docs), col(id_col).cast("long").alias("id")), ["id"], gone, "some")
    stay = flagged.filter("not some").select("row")
    rest = flagged.filter("some").join(gone, F.col("id") == F.col("gone"), "left_anti").select("row")
    return opened(stay.unionByName(rest))


def op1_minhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
