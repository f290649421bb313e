"""Repeated passages and language-model scores against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratum.llm import lm, repeats
from stratum.llm.suffixes import suffix_order


def test_suffix_order():
    rng = random.Random(2)
    for n in (1, 2, 3, 4, 5, 10, 97, 600):
        for k in (1, 2, 4, 200):
            s = [rng.randint(1, k) for _ in range(n)]
            assert suffix_order(np.array(s)).tolist() == sorted(range(n), key=lambda i: s[i:]), (n, k)


def plain(rows, length):
    raw = [(r["text"] or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, raw, strict=True):
        gone = [False] * (len(t) + 1)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((str(r["doc_id"]), len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def cleaned(docs, **options):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(docs, **options).collect())


def test_repeats(small, nothing):
    assert cleaned(small) == plain(small.collect(), 200)
    assert repeats.remove_repeats(nothing).count() == 0


def awkward():
    """Periodic, nearly periodic and Thue-Morse texts, and copies with single bytes changed."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    morse = "a"
    while len(morse) < 2048:
        morse += morse.translate(str.maketrans("ab", "ba"))
    out = [morse, morse[:1024], morse[1024:], "ab" * 450, "abc" * 300 + "x" + "abc" * 300, "z" * 3000, "y" * 199 + "q" + "y" * 200]
    for d in (1, 7, 33, 90, 167, 168, 169, 199, 200, 201):
        unit = text(d)
        near = list((unit * 900)[: 600 + d])
        near[350] = "!"
        out += [text(50) + (unit * 900)[: 200 + d] + text(40), "".join(near), text(30) + (unit * 900)[: 199 + d]]
    base = text(5000)
    out += [base, base[:2500] + "?" + base[2500:], base[1000:1199], base[1000:1200], text(9) + base[3000:3300] + text(9), base, ""]
    return out


@pytest.mark.parametrize("stretch, hot", [(2_000_000, 500), (37, 500), (300, 1)])
def test_awkward_texts(spark, monkeypatch, stretch, hot):
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    monkeypatch.setattr(repeats, "HOT_TEXTS", hot)
    docs = spark.createDataFrame(list(enumerate([*awkward(), awkward()[0], None])), "doc_id long, text string")
    docs = docs.unionByName(docs.limit(3))
    assert cleaned(docs) == plain(docs.collect(), 200)


def test_long_texts(spark):
    rng = random.Random(13)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    rows = [(1, long), (2, long[:700_000] + "|" + long[700_000:]), (3, long[123_456:123_756]), (4, "x" * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert cleaned(docs) == plain(docs.collect(), 200)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 9)), min_size=1, max_size=12), st.integers(0, 10**6))
def test_runs_of_periodic_texts_hold_all_their_anchors(shape, seed):
    rng = random.Random(seed)
    raw = b"".join(bytes(rng.choice(b"ab") for _ in range(n)) * k for n, k in shape) * 8 + bytes(rng.choice(b"ab") for _ in range(240))
    data = np.frombuffer(raw, np.uint8)
    gram = repeats.gram_hashes(data)
    names: dict = {}
    assert len({(int(h), names.setdefault(raw[i : i + repeats.GRAM], i)) for i, h in enumerate(gram)}) == len(names)  # equal hashes, equal grams
    for start, windows, anchor, times in zip(*repeats.find_runs(data, 200), strict=True):
        assert times == (gram[start : start + windows + 200 - repeats.GRAM] == anchor).sum()


def test_repeats_with_divided_anchors(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(260)
    rows = [(i, text(rng.randint(0, 300)) + passage[rng.randint(0, 40) : rng.randint(215, 260)] + text(100)) for i in range(40)]
    rows += [(50, "ab" * 300), (51, "x" * 199), (52, "x" * 200), (53, "y" * 201), (54, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain(docs.collect(), 200)
    assert cleaned(docs) == expected
    monkeypatch.setattr(repeats, "HOT_TEXTS", 2)
    assert cleaned(docs) == expected


def test_runs_count_their_anchor_in_their_whole_span():
    rng = random.Random(5)
    for d in (40, 80, 120, 168):
        for _ in range(600):
            unit = rng.randbytes(d)
            data = np.frombuffer(rng.randbytes(300) + (unit * 9)[: 200 + d] + rng.randbytes(300), np.uint8)
            gram = repeats.gram_hashes(data)
            for start, windows, anchor, times in zip(*repeats.find_runs(data, 200), strict=True):
                assert times == (gram[start : start + windows + 200 - repeats.GRAM] == anchor).sum()


def test_short_periodic_passages(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for d in (40, 80, 120):
        for _ in range(700):
            unit = text(d)
            rows.append((len(rows), text(300) + (unit * 7)[: 200 + d] + text(300)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert cleaned(docs) == plain([{"doc_id": i, "text": t} for i, t in rows], 200)


def test_scores(small, nothing):
    rows = small.collect()
    split = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    words = [split(r["text"]) for r in rows]
    for order in (1, 2, 3):
        grams = [[Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)] for w in words]
        total = [sum((g[n] for g in grams), Counter()) for n in range(order)]
        n_all = sum(map(len, words))
        expected = []
        for r, w, own in zip(rows, words, grams, strict=True):
            left = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
            score = 0.0
            for i in range(len(w)):
                value = math.log(max(left((w[i],)), 0.5) / max(1, n_all - len(w)))
                for n in range(2, min(order, i + 1) + 1):
                    g = tuple(w[i - n + 1 : i + 1])
                    value = math.log(left(g) / max(left(g[:-1]), 1)) if left(g) > 0 else value + math.log(0.4)
                score += value
            expected.append((str(r["doc_id"]), len(w), round(score, 6)))
        got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["log_score"], 6)) for r in lm.score_documents(small, order=order, block_bytes=5000).collect())
        assert got == sorted(expected)
    assert lm.score_documents(nothing).count() == 0


def test_keys_keep_all_their_bits():
    rng = np.random.default_rng(3)
    for bits in (8, 11, 15, 16, 23):
        keys = np.sort(rng.integers(0, 2**64, 3000, dtype=np.uint64))
        for part in np.unique(keys >> np.uint64(64 - bits))[:40]:
            own = keys[keys >> np.uint64(64 - bits) == part]
            assert (lm._unpack_keys(lm._pack_keys(own, bits), bits, int(part)) == own).all()
