"""Shards, mixtures and packing: laws and plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratum.llm import mixing, packing, sharding
from stratum.llm.tokens import IdBytes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_slots(out):
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def check_shards(docs, out, shards):
    assert Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == Counter((str(d["doc_id"]), len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in docs)
    total, slots = Counter(), defaultdict(list)
    for r in out:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(total) <= set(range(shards))
    most, mean = max(r["size"] for r in out), sum(total.values()) / shards
    assert all(abs(total[s] - mean) <= most + 1 for s in range(shards))


def test_shards(spark, small, nothing):
    check_shards(small.collect(), sharding.shard(small, 3).collect(), 3)
    rows = [(i, "same text" if i % 3 else f"text {i} " * (i % 9)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a = sharding.shard(docs, 5, ranges=16, oversample=1).collect()
    check_shards(docs.collect(), a, 5)
    b = sharding.shard(docs, 5, ranges=40, oversample=9, seed=3).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in a} == {(r["doc_id"], r["shard"], r["slot"]) for r in b}  # the sample shapes tasks only
    assert sharding.shard(nothing).count() == 0


def plain_shards(docs, shards, together):
    """(doc_id, size, shard) by the law: documents in the order of (text hash, id), cut at equal bytes, small groups whole."""
    rows = sorted((int(hashlib.md5((d["text"] or "").encode()).hexdigest()[:15], 16), -(1 << 63) if d["doc_id"] is None else d["doc_id"], len((d["text"] or "").encode()) + 8) for d in docs)
    total, copies, at, out = sum(r[2] for r in rows), Counter(), 0, []
    for key, _, size in rows:
        copies[key] += size
    first = {}
    for key, doc, size in rows:
        first.setdefault(key, at)
        middle = 2 * first[key] + copies[key] if copies[key] <= total * together / shards else 2 * at + size
        out.append((doc, size, middle * shards // (2 * total)))
        at += size
    return Counter(out)


def test_shards_equal_a_plain_version(spark, small):
    rows = [(None if i % 50 == 0 else i // 2, ["same text", "other text " * 3, f"text {i} " * (i % 9)][i % 3 if i > 100 else 2]) for i in range(700)]
    for docs, together in ((spark.createDataFrame(rows, "doc_id long, text string"), 0.01), (spark.createDataFrame(rows, "doc_id long, text string"), 2.0), (small, 0.01), (small, 0.5)):
        for ranges in (3, 64):
            out = sharding.shard(docs, 7, ranges=ranges, oversample=2, together=together).collect()
            check_slots(out)
            assert Counter((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["size"], r["shard"]) for r in out) == plain_shards(docs.collect(), 7, together)


def test_rows_without_id_and_one_text_are_divided(spark):
    docs = spark.createDataFrame([(None, "the same")] * 900, "doc_id long, text string")
    out = sharding.shard(docs, 6, ranges=30, oversample=4).collect()
    assert set(Counter(r["shard"] for r in out).values()) == {150}
    check_slots(out)
    rows = docs.select(F.lit(1).alias("key"), F.lit(0).alias("tie"), F.monotonically_increasing_id().alias("nth"), F.lit(10).alias("size"))
    bounds = sharding.range_bounds(rows, 30, 4, 1)
    assert max(r[1] for r in rows.groupBy(sharding._range_of(bounds).alias("r")).count().collect()) < 200


def test_overfull_ranges_are_divided(spark):
    rows = spark.createDataFrame([(1, i, i, 10) for i in range(500)] + [(10**6 + i, i, i, 10) for i in range(500)], "key long, tie long, nth long, size long")
    bounds = sharding.range_bounds(rows, 20, 1, 1)
    sizes = [r[1] for r in rows.groupBy(sharding._range_of(bounds).alias("r")).count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 300


def tree(**more):
    return {"levels": mixing.default_tree(), "tokens": mixing.word_count(F.col("text")), **more}


def test_word_count(spark):
    texts = [None, "", " \t", "a", " a  b\n", "x\x0by\x0cz", "x\u00a0y"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", mixing.word_count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [max(1, len((t or "").encode().split())) for t in texts]


def test_mix(small, nothing):
    out = mixing.mix(small, **tree(total_share=1.0, rows_per_bucket=2)).collect()
    domain = lambda s: f"d{int(re.search('[0-9]+', s or '0')[0]) % 4}"
    leaf = lambda r: (domain(r["source"]), r["lang"], r["source"])
    count = lambda r: max(1, len((r["text"] or "").encode().split()))
    supply, took, budget = Counter(), Counter(), {}
    for d in small.collect():
        supply[leaf(d)] += count(d)
    for r in out:
        took[leaf(r)] += count(r)
        budget[leaf(r)] = r["budget"]
        assert r["score"] == "mine"
    assert all(took[k] <= budget[k] <= 2 * supply[k] for k in budget)
    assert mixing.mix(nothing, **tree()).count() == 0


def test_partial_epochs_take_the_prefix_of_the_order(spark):
    """Rows without an id are ordered too: the prefix fits as much of the budget as it can."""
    docs = spark.createDataFrame([(None, f"w {i} " * (1 + i % 5), "en", "s1") for i in range(60)] + [(i, "a b c", "de", "s1") for i in range(10)], "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs, **tree(total_share=0.5, rows_per_bucket=4, columns=True)).collect()
    most = max(2 * (1 + i % 5) for i in range(60))
    for lang in ("en", "de"):
        rows = [r for r in out if r["lang"] == lang]
        assert 0 <= rows[0]["budget"] - sum(len(r["text"].split()) for r in rows) < most


def test_budgets_move_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 10), ("a", "en", "s2", 100), ("b", "en", "s3", 100), ("b", "de", "s4", 5)], "domain string, lang string, source string, cap long")
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, 120, weights={}).collect()}
    assert got == {"s1": 10, "s2": 50, "s3": 55, "s4": 5}
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, 1000, weights={}).collect()}
    assert got == {"s1": 10, "s2": 100, "s3": 100, "s4": 5}


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def quick():
    return IdBytes(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", " ", "  ", "\n", "\t", " ", " ", "É", "9", "'s", "!!", "<|endoftext|>", "\U0001f600", "\x1c"])).map("".join))
def test_ids_equal_the_tokenizers(plain, quick, text):
    import numpy as np

    assert np.frombuffer(quick(text), "<u4").tolist() == plain(text)


@pytest.mark.parametrize("text", ["ab " * 700_000, "a" * 300_000, " " * 300_000 + "x", "word  " * 300_000, "x" * 1_200_000 + " <|endoftext|> y"])
def test_ids_of_long_texts(plain, quick, text):
    import numpy as np

    assert np.frombuffer(quick(text), "<u4").tolist() == plain(text)


def test_pack(small, nothing, plain):
    import numpy as np

    out = packing.pack(small, PATH, size=64).collect()
    ids = Counter()
    for d in small.collect():
        own = np.array([*plain(d["text"] or ""), 2], "<u4")
        begin, stop, k = 0, (len(own) - 1) % 64 + 1, 0
        while begin < len(own):
            ids[(str(d["doc_id"]), k, begin, stop - begin, zlib.crc32(own[begin:stop].tobytes()))] += 1
            begin, stop, k = stop, stop + 64, k + 1
    assert Counter((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == ids
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(nothing, PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    room, bins = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(50 - n)
            bins += 1
    runs = packing.plan(dict(Counter(lengths)), 50)
    used = defaultdict(list)
    for length, a, b, first, per, offset in runs:
        for r in range(a, b):
            used[first + (r - a) // per].append((offset + (r - a) % per * length, length))
    assert len(used) == bins and sum(map(len, used.values())) == len(lengths)
    assert sorted(50 - sum(n for _, n in b) for b in used.values()) == sorted(room)
