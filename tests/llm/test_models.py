"""Language, quality and nearest neighbours: edges, held-out accuracy and recall."""

import random
from collections import Counter

import numpy as np
import plain
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratum.llm import ann, langid, quality

DATA = "/root/testdata/sf0.01"


def test_language_edges(small, nothing):
    known = langid.profiles(small, F.lit(True))
    out = langid.identify(small, known).collect()
    assert len(out) == small.count()
    for r in out:
        blank = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == blank and 0 <= r["score"] <= 1
        assert blank or r["lang_pred"] in known
    assert langid.identify(nothing, known).count() == 0 and langid.profiles(nothing, F.lit(True)) == {}
    assert {r["lang_pred"] for r in langid.identify(small, {}).collect()} == {"und"}
    kept = langid.keep_known(small)
    assert kept.columns == small.columns and {r["score"] for r in kept.collect()} == {"mine"}
    assert {r["lang"] for r in kept.collect()} <= set(known)
    assert langid.keep_known(nothing).count() == 0


def test_profile_order(spark):
    docs = spark.createDataFrame([("x", "aab ab"), (None, "zzz"), ("x", None)], "lang string, text string")
    got = langid.profiles(docs, F.lit(True), size=3)
    assert list(got) == ["x"] and got["x"][0] == ord("a")


def test_languages_equal_a_plain_version(spark, small):
    for docs in (small, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = [r.asDict() for r in docs.collect()]
        known = langid.profiles(docs, ~F.coalesce(langid.fold(F.col("doc_id"), 4) == 2, F.lit(False)))
        want = plain.language_profiles(rows, lambda r: plain.fold(r["doc_id"], 4) != 2)
        assert known == {k: [plain.code(g) for g in v] for k, v in want.items()}
        got = Counter((r["doc_id"], r["lang_pred"], round(r["score"], 12)) for r in langid.identify(docs, known, keep=["doc_id"]).collect())
        assert got == Counter((r["doc_id"], lang, round(score, 12)) for r in rows for lang, score in [plain.language(r["text"], want)])


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aBé ß1\n中-"), max_size=40), st.integers(1, 9))
def test_grams_of_any_stretch(text, stretch):
    kept, langid.STRETCH = langid.STRETCH, stretch
    try:
        codes, n = langid.gram_counts(text) if text else ([], [])
    finally:
        langid.STRETCH = kept
    got = {int(c): int(k) for c, k in zip(codes, n, strict=True) if len(codes) > 1}
    assert got == {plain.code(g): k for g, k in plain.grams(text).items()}


def test_language_held_out(spark):
    got = langid.op6_langid(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.97


def test_quality_edges(spark, small, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = quality.classify(small, labels, F.lit(True)).collect()
    assert len(out) == small.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert quality.classify(nothing, labels, F.lit(True)).count() == 0
    assert len({r["score"] for r in quality.classify(small, labels.limit(0), F.lit(True)).collect()}) == 1
    assert all(len(quality.text_features(t)) == len(quality.FEATURES) for t in (None, "", " ", "a", "x y\nz"))


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(st.sampled_from("aB1 .!|#é\n\t,~"), max_size=60)), st.integers(1, 20))
def test_features_equal_a_plain_version(text, stretch):
    kept, quality.STRETCH = quality.STRETCH, stretch
    try:
        got = quality.text_features(text)
    finally:
        quality.STRETCH = kept
    assert np.allclose(got, plain.quality_features(text), atol=1e-12)


def test_fit_equals_a_plain_version():
    """Cyclic boosting by loops over rows and cuts, on few rows and features."""
    import math

    rng = np.random.default_rng(7)
    x = rng.integers(0, 9, (120, 3)).astype(np.float32)
    y = ((x[:, 0] + rng.random(120) > 5) ^ (x[:, 1] > 3)).astype(float)
    options = {"bins": 6, "rounds": 4, "leaves": 3, "rate": 0.3, "pairs": 2, "pair_bins": 4, "pair_rounds": 3, "ridge": 1.0, "least": 1.0}
    rows, n = range(120), 120

    def edges(f, k):
        return sorted({float(np.quantile(x[:, f], i / k)) for i in range(1, k)})

    def bin_of(cuts, v):
        return sum(v >= c for c in cuts)

    share = (y.sum() + 0.5) / (n + 1)
    margin = [math.log(share / (1 - share))] * n

    def slopes():
        p = [1 / (1 + math.exp(-m)) for m in margin]
        return [y[r] - p[r] for r in rows], [p[r] * (1 - p[r]) for r in rows]

    def worth(g, h, own):
        return sum(g[r] for r in own) ** 2 / (sum(h[r] for r in own) + 1)

    for _ in range(4):
        for f in range(3):
            g, h = slopes()
            at = [bin_of(edges(f, 6), x[r, f]) for r in rows]
            spans = [(0, len(edges(f, 6)) + 1)]
            while len(spans) < 3:
                best = (1e-9, None)
                for a, b in spans:
                    for c in range(a + 1, b):
                        left, right = ([r for r in rows if lo <= at[r] < hi] for lo, hi in ((a, c), (c, b)))
                        gain = worth(g, h, left) + worth(g, h, right) - worth(g, h, left + right)
                        if min(sum(h[r] for r in left), sum(h[r] for r in right)) >= 1 and gain > best[0] + 1e-12:
                            best = (gain, (a, b, c))
                if best[1] is None:
                    break
                a, b, c = best[1]
                spans = [s for s in spans if s != (a, b)] + [(a, c), (c, b)]
            for a, b in spans:
                own = [r for r in rows if a <= at[r] < b]
                step = 0.3 * sum(g[r] for r in own) / (sum(h[r] for r in own) + 1)
                for r in own:
                    margin[r] += step

    def quarters(i, j, g, h):
        ci, cj = edges(i, 4), edges(j, 4)
        best = None
        for a in range(1, len(ci) + 1):
            for b in range(1, len(cj) + 1):
                cells = [[], [], [], []]
                for r in rows:
                    cells[2 * (bin_of(ci, x[r, i]) >= a) + (bin_of(cj, x[r, j]) >= b)].append(r)
                gain = sum(worth(g, h, c) for c in cells) - worth(g, h, list(rows))
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, cells)
        return best

    g, h = slopes()
    pairs = sorted(((quarters(i, j, g, h)[0], i, j) for i in range(3) for j in range(i)), reverse=True)[:2]
    for _ in range(3):
        for _, i, j in pairs:
            g, h = slopes()
            for own in quarters(i, j, g, h)[1]:
                step = 0.3 * sum(g[r] for r in own) / (sum(h[r] for r in own) + 1)
                for r in own:
                    margin[r] += step
    assert np.allclose(quality.fit(x, y, **options).score(x), [1 / (1 + math.exp(-m)) for m in margin], atol=1e-9)


def test_quality_held_out(spark):
    got = quality.op8_quality(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality.fit(x, y, rounds=10).score(x) > 0.5) == y).mean() > 0.95
    assert ((quality.fit(x, y, rounds=10, pairs=0).score(x) > 0.5) == y).mean() < 0.7


def exact(rows, queries, k):
    out = {}
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in rows if i != q)
        out[q] = near[:k]
    return out


def test_neighbours(spark):
    rng = random.Random(4)
    good = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]) for i in range(400)]
    good += [(400 + i, good[7][1]) for i in range(30)]  # a vector repeated often
    bad = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [None] + [1.0] * 7), (904, [float("inf")] * 8), (906, []), (None, [1.0] * 8)]
    vectors = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>")
    queries = vectors.filter("vec_id % 10 = 0 or vec_id is null")
    got: dict = {}
    for r in ann.search(vectors, queries, probes=1.0, block_rows=50).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact(good, [g for g in good if g[0] % 10 == 0], 10)
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        hits += len({r[1] for r in rows} & {i for _, i in want[q]})
        scores = dict((i, s) for s, i in exact(good, [(q, dict(good)[q])], len(good))[q])
        assert all(abs(scores[i] - s) < 1e-9 for _, i, s in rows)
    assert hits >= 0.98 * 10 * len(want)
    assert got[410][0][1] == 7 and [r[1] for r in got[410]][1] == 400
    few = vectors.filter("vec_id in (10, 20, 33)")
    assert ann.search(few, few).count() == 6
    assert ann.search(vectors.limit(0), queries).count() == 0


def test_recall_on_the_table(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in v.collect()]
    want = exact(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = ann.op5_ann(spark, DATA).collect()
    assert sum(any(i == r["vec_id"] for _, i in want[r["query_id"]]) for r in got) >= 0.9 * sum(map(len, want.values()))


def test_every_dimension_is_searched(spark):
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(30)] + [(100, [1.0, 2.0]), (101, [1.0, 4.0]), (102, [5.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(v, v.filter("vec_id in (0, 100, 102)"), k=2, sample=20).collect()}
    assert got == {(0, 1): (1, 1.0), (0, 2): (2, 2.0), (100, 1): (101, 2.0)}
