"""The pipeline against a plain version of its five stages, row by row."""

import random
import re
from collections import Counter, defaultdict
from math import comb

import plain
import public_tokenizers
import pytest

import corpus_pipeline
from stratum.llm import minhash
from stratum.llm.langid import LEAST_SCORE
from stratum.llm.mixing import WEIGHTS
from stratum.llm.scratch import settle

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_stages(rows):
    """The rows (dicts) that each of the first four stages leaves."""
    known = plain.language_profiles(rows, lambda r: plain.fold(r["doc_id"], 4) != 2)
    told = [(r, *plain.language(r["text"], known)) for r in rows]
    rows = [r | {"lang": lang} for r, lang, score in told if lang != "und" and score >= LEAST_SCORE]
    yield rows
    last = {}
    for r in rows:
        text = r["text"] or ""
        if text not in last or (r["doc_id"] is not None and (last[text]["doc_id"] is None or r["doc_id"] > last[text]["doc_id"])):
            last[text] = r
    rows = list(last.values())
    yield rows
    group = plain.near_groups([(r["doc_id"], r["text"]) for r in rows], 80)
    rows = [r for r in rows if r["doc_id"] is None or group[r["doc_id"]] == r["doc_id"]]
    yield rows
    domain = lambda r: f"d{int((re.search('[0-9]+', r['source'] or '') or ['0'])[0]) % 4}"
    rows = plain.mixture(rows, lambda r: (domain(r), r["lang"], r["source"]), lambda r: max(1, len((r["text"] or "").encode().split())), 1.0, [WEIGHTS.get(k, {}) for k in ("domain", "lang", "source")])
    yield rows


def as_rows(df):
    return Counter(tuple(sorted((k, str(v)) for k, v in r.asDict().items())) for r in df.collect())


def check(spark, docs):
    columns, rows = docs.columns, [r.asDict() for r in docs.collect()]
    for (_, stage), expected in zip(corpus_pipeline.STAGES, plain_stages(rows), strict=False):
        docs = settle(stage(spark, docs, DATA), "t")
        assert docs.columns == columns
        assert as_rows(docs) == Counter(tuple(sorted((k, str(v)) for k, v in r.items())) for r in expected)
    out = corpus_pipeline.packed(spark, docs, DATA).collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    want = plain.pieces(expected, lambda t: own.encode(t, add_special_tokens=False).ids, 1024)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == Counter(want)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))]
    assert sorted(1024 - sum(n for _, n in b) for b in bins.values()) == sorted(plain.best_fit([w[3] for w in want], 1024))


def test_every_stage_on_the_smallest_table(spark):
    check(spark, spark.read.parquet(f"{DATA}/documents.parquet").dropDuplicates(["doc_id"]))


def test_every_stage_on_awkward_rows(spark):
    """Nulls, empties, repeats, letterless and foreign texts, and columns named like everything inside."""
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    rows = [(i, text("etaoinsh" if i % 2 else "äöüßerng", 60 + i), "en" if i % 2 else "de", f"src{i % 5}") for i in range(40)]
    rows += [(100 + i, rows[i][1], rows[i][2], None) for i in range(8)] + [(200 + i, rows[i][1] + " more", None, "src1") for i in range(8, 14)]
    rows += [(300, None, "en", "src1"), (301, "", None, None), (302, " \n\t", "en", "src2"), (303, "123 456 !!", "de", "src3"), (304, "中文字符 " * 30, None, "src1"), (None, text("etaoinsh", 50), None, "src0"), rows[3], rows[3]]
    names = ("row", "id", "digest", "tokens", "domain", "score", "kept", "epoch", "budget", "lang_pred", "key", "gone", "some", "_order", "level0", "tie", "tag", "maybe")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *[f"my {n}" for n in names]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    check(spark, docs)


def test_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, settle(stage(spark, docs, DATA), "t")
        assert docs.count() == 0 and (name == "packing" or docs.columns == columns)


def test_foreign_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = spark.createDataFrame([(10**6, "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι " * 9, "en", "s"), (10**6 + 1, "すべての人間は生まれながらにして自由であり " * 9, None, "s")], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs.unionByName(more, allowMissingColumns=True), DATA).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}


def smallest_of_groups(rows):
    return sorted(i for i, r in plain.near_groups(rows, 80).items() if i == r)


def test_near_dedup_links_from_080(spark):
    rows = []
    for k in range(30):
        whole, short = [f"w{k}x{i}" for i in range(204)], [f"s{k}x{i}" for i in range(49)]
        changed = lambda words, at: " ".join("other" if i in at else w for i, w in enumerate(words))
        texts = [changed(whole, ()), changed(whole, (20, 60, 100, 140)), changed(whole, (20, 60, 100, 140, 180, 190)), changed(short, ()), changed(short, (24,)), changed(short, (12, 36))]
        rows += [(10 * k + i, t) for i, t in enumerate(texts)]
    ratio = lambda a, b: len(plain.shingle_set(a) & plain.shingle_set(b)) / len(plain.shingle_set(a) | plain.shingle_set(b))
    assert 0.8 < ratio(rows[0][1], rows[1][1]) < 0.85 and ratio(rows[3][1], rows[4][1]) == 0.8 and ratio(rows[3][1], rows[5][1]) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, DATA).collect()) == smallest_of_groups(rows)


@pytest.mark.parametrize("numerator", (80, 85))
def test_few_links_at_the_threshold_are_missed(numerator):
    t, rows = numerator / 100, minhash.band_rows(numerator)
    assert (1 - t**rows) ** (minhash.LENGTH // rows) < 1e-6
    assert sum(comb(minhash.LENGTH, k) * t**k * (1 - t) ** (minhash.LENGTH - k) for k in range(minhash.alike(numerator))) < 1e-6
