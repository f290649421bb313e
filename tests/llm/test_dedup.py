"""Exact and near dedup against plain versions."""

import hashlib
from collections import Counter

import pytest
from plain import near_groups, shingle_set

from stratum.llm import components as C
from stratum.llm import exact_dedup as X
from stratum.llm import minhash as M


def test_exact(small):
    rows = small.collect()
    out = X.exact_dedup(small).collect()
    size = Counter(r["text"] or "" for r in rows)
    best = {}
    for r in rows:
        t = r["text"] or ""
        best[t] = max(best.get(t, -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert len(out) == len(rows)
    for r in out:
        t = r["text"] or ""
        assert r["group_size"] == size[t] and r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert r["keep_id"] == (None if best[t] < 0 else best[t]) and r["score"] == "mine"
    kept = [r for r in out if r["kept"]]
    assert Counter(r["text"] or "" for r in kept) == {t: 1 for t in size}
    assert X.keep_first(small).columns == small.columns and X.keep_first(small).count() == len(size)


def test_exact_with_a_full_filter_gives_the_same(small):
    a = X.exact_dedup(small, carry=["doc_id"]).collect()
    b = X.exact_dedup(small, carry=["doc_id"], max_filter_bits=8, bits_per_row=1, hashes=1).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


#: Every name that the operators use inside, and their outputs.
NAMES = (
    "row", "id", "digest", "maybe", "tag", "p0", "p1", "block0", "block1", "bits0", "bits1", "block", "bits", "p", "n", "t", "stay", "keep_id", "group_size", "kept", "text_sha256", "_id", "_digest", "_tag", "_maybe", "_b0", "_p0",
    "some", "gone", "own", "k", "u", "v", "left", "member_at0", "member_block0", "member_bits1", "_some", "_gone", "component_id", "epoch", "budget", "tokens", "tie", "level0", "level1", "level2", "supply", "rows", "cap",
    "_leaf", "_l", "_whole", "_rest", "_buckets", "_bucket", "_order", "_epochs", "_cut", "_last", "_level0", "_given", "domain", "lang_pred", "score", "with space", "a.b", "tick`s",
)


def test_columns_of_any_name_pass_unchanged(spark):
    from pyspark.sql import functions as F

    from stratum.llm import langid, mixing

    texts = [f"one text of some words {i % 4}" for i in range(9)] + [None, ""]
    plain_rows = [(i, t, "en", "s1", *[f"{n} of {i}" for n in NAMES]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(plain_rows, ["doc_id", "text", "lang", "source", *NAMES])
    mine = {r[0]: tuple(r) for r in plain_rows}
    kept = {"exact": X.keep_first(docs), "near": M.keep_one(docs), "mix": mixing.mix(docs, mixing.default_tree(), mixing.word_count(F.col("text")), columns=False), "lang": langid.keep_known(docs)}
    for out in kept.values():
        rows = out.collect()
        assert out.columns == docs.columns and len(rows) > 2 and all(tuple(r) == mine[r[0]] for r in rows)
    outputs = {"keep_id", "group_size", "kept", "text_sha256", "epoch", "budget", "lang_pred", "score"}
    for out in (X.exact_dedup(docs), mixing.mix(docs, mixing.default_tree(), mixing.word_count(F.col("text"))), langid.identify(docs, {})):
        for r in out.collect():
            assert all(r[c] == mine[r["doc_id"]][docs.columns.index(c)] for c in docs.columns if c not in outputs)


def test_exact_of_nothing(nothing):
    assert X.exact_dedup(nothing).count() == 0


def test_near(small):
    rows = small.collect()
    out = M.near_duplicates(small).collect()
    comp = near_groups([(r["doc_id"], r["text"]) for r in rows], 85)
    assert len(out) == len(rows)
    assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in out) == sorted((str(r["doc_id"]), len(shingle_set(r["text"]))) for r in rows)
    for r in out:
        assert r["component_id"] == comp.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or comp[r["doc_id"]] == r["doc_id"])
    assert comp[2] == comp[3] == 1 and comp[13] == 12 and comp[8] == 7 and comp[9] == 9


def test_near_keeps_columns_and_texts(small, nothing):
    kept = M.keep_one(small)
    assert kept.columns == small.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, 1, 4, 5, 6, 7, 9, 10, 11, 12, 14, 15, 16, 17, 19}
    assert M.near_duplicates(nothing).count() == 0


def test_links_missed_by_every_centre(spark):
    """A chain: neighbours are linked, the ends are not, so no one centre sees all."""
    words = [f"w{i}" for i in range(240)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 200])) for i in range(10)] + [(100 + i, " ".join(f"z{i}q{k}" for k in range(50))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(docs).collect()}
    assert all(got[i] == 0 for i in range(10)) and all(got[i] == i for i in range(100, 120))


def test_signatures_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (700, 100, 100))
    h = np.concatenate((np.sort(np.concatenate((common, a))), np.sort(np.concatenate((common, b)))))
    doc = np.repeat([0, 1], 800)
    sig = M.signatures(doc, h, 2, 240)
    assert abs((sig[0] == sig[1]).mean() - 700 / 900) < 0.1


@pytest.mark.parametrize("task_edges", [1_000_000, 9])
def test_components(spark, monkeypatch, task_edges):
    monkeypatch.setattr(C, "TASK_EDGES", task_edges)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 100)] + [(300, 300 + i) for i in range(1, 30)]
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[101] == 100 and got[329] == 300 and len(got) == 41 + 3 + 30


def test_signature_check_rarely_fails_a_pair_at_085():
    from math import comb

    p = 0.85 + 0.15 / 256  # bytes of different slots may be equal
    assert sum(comb(M.LENGTH, k) * p**k * (1 - p) ** (M.LENGTH - k) for k in range(M.alike(85))) < 1e-7


def test_words_that_a_polynomial_takes_for_equal(spark):
    """Thue-Morse strings and their complements have one polynomial hash modulo 2^64, whatever its base."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, f"{a} {b} x y z w"), (4, f"{b} {a} x y z w"), (5, a)]
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_links_are_confirmed_on_words(spark, monkeypatch):
    """Even if all hashes were one, texts that differ are not linked."""
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g"), (3, "A B C D E F")], "id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "u long, v long")
    assert [tuple(r) for r in M.verify(pairs, texts, 85).collect()] == [(1, 3)]


def test_large_buckets_in_many_blocks(spark, monkeypatch):
    """Hundreds of texts with a long common passage share buckets; some are linked, most are not."""
    import random

    monkeypatch.setattr(M, "LARGE_BUCKET", 4)
    rng = random.Random(9)
    common = [f"c{i}" for i in range(400)]
    rows = []
    for i in range(260):
        own = [f"u{i}x{k}" for k in range(rng.choice((70, 90, 120, 200)))]
        rows.append((i, " ".join(common + own)))
    rows += [(1000 + i, " ".join([*common, *[f"g{k}" if (k * 7 + i) % 41 else f"d{i}x{k}" for k in range(300)]])) for i in range(120)]  # alike to each other
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_groups(rows, 85)
    assert 1 < len(set(want.values())) < len(rows)
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(docs, block=16).collect()}
    assert got == want


def test_stretches_make_no_difference(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 50, n))) for n in (0, 3, 4, 5, 6, 300, 4000)] + ["x" * 5000, " " * 900, "a " * 2000]
    whole = M.shingles(texts)
    sig = M.signatures(whole[0], whole[1], len(texts))
    monkeypatch.setattr(M, "STRETCH", 200)
    monkeypatch.setattr(M, "ELEMENTS", 97)
    parts = M.shingles(texts)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert (M.signatures(parts[0], parts[1], len(texts)) == sig).all()


def test_tables_go_after_use(spark, small, tmp_path, monkeypatch):
    from stratum.llm import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    before = spark.conf.get(scratch.ARROW_ROWS)
    out = M.near_duplicates(small)
    left = [p for p in tmp_path.glob("stratum-*/*/*") if p.is_dir()]
    assert {p.name for p in left} <= {"signed", "classes", "components", "whole"}
    assert out.count() == small.count() and spark.conf.get(scratch.ARROW_ROWS) == before
