"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams, in order, over all its training rows. A document's own most
frequent n-grams are looked up in each profile; the out-of-place distance sums how far their ranks differ, and the
nearest profile names the language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.llm.columns import col, opened, whole
from stratum.llm.scratch import documents, modest_batches, settle
from stratum.llm.workers import stream, tidy, worker_memo

UNDETERMINED = "und"
LEAST_SCORE = 0.35  # no held-out text of a learned language scored below 0.42 at sf0.1; letters that no profile knows score 0
BITS = 21  # of a code point
STRETCH = 1_000_000  # characters of a long text that are worked through at once
CODES = 250_000  # n-grams a worker holds of a language before it sums them


def _letters():
    """Code point -> lower-case letter, or 0; the first one where it lowers to several."""
    import numpy as np

    memo = worker_memo()
    if "letters" not in memo:
        table = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = ord(ch.lower()[0])
        memo["letters"] = table
    return memo["letters"]


def gram_codes(text: str, before=(0,), last: bool = True):
    """All n-grams of 1 to 3 letters of each word, with one blank before and after the word, as int64 codes.

    A blank in front adds nothing to a code: the first letters of words count once more as shorter grams.
    ``before`` are the last symbols, at most two, of what stands before the text, and ``last`` says that nothing
    follows it. Gives the codes and the last two symbols.
    """
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    s = np.concatenate((before, _letters()[points], [0] * last)).astype(np.int64)
    keep = np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))  # one blank between words
    keep[: len(before)] = True
    s, old = s[keep], len(before)
    letter = s != 0
    two = (s[:-1] << BITS) | s[1:]
    three = (two[:-1] << BITS) | s[2:]
    return np.concatenate((s[old:][letter[old:]], two[old - 1 :], three[max(old - 2, 0) :][letter[1:-1][max(old - 2, 0) :]])), s[-2:]


def gram_counts(text: str):
    """Distinct n-grams in order and how often each occurs. A long text is worked through in stretches."""
    import numpy as np

    before, held = np.zeros(1, np.int64), None
    for at in range(0, len(text), STRETCH):
        codes, before = gram_codes(text[at : at + STRETCH], before, at + STRETCH >= len(text))
        found = _counts(codes)
        held = found if held is None else _counts(*(np.concatenate(x) for x in zip(held, found, strict=True)))
    return held


def _counts(codes, n=None):
    """Distinct codes in order, and how often each occurs (or the sums of n)."""
    import numpy as np

    if n is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))
    sums = np.diff(np.concatenate((at, [len(codes)]))) if n is None else np.add.reduceat(n, at) if len(at) else n
    return codes[at], sums


def _top(codes, counts, k: int):
    """The k most frequent codes in order; ties to the smaller code (codes come sorted)."""
    import numpy as np

    if len(codes) > k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        keep = counts >= least  # with all ties of the last
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")[:k]]


def profiles(docs: DataFrame, train: Column, lang_col: str = "lang", text_col: str = "text", size: int = 400, salts: int = 64) -> dict[str, list[int]]:
    """language -> its ``size`` most frequent n-grams in order, over the rows where train holds and lang isn't null.

    Counts cover every such row: tasks sum their rows in bounded memory, the sums meet by (language, n-gram). The driver gets at most
    salts * size n-grams for each language; the number of languages is that of the labels.
    """

    def count(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[str, list] = {}  # language -> pieces of (codes, counts), summed whenever they reach CODES
        size: dict[str, int] = {}

        def sum_up(lang):
            codes, n = _counts(*(np.concatenate(x) for x in zip(*held[lang], strict=True)))
            held[lang], size[lang] = [(codes, n)], 0
            return codes, n

        def flush(lang):
            codes, n = sum_up(lang)
            del held[lang]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

        for batch in batches:
            for lang, text in zip(stream(batch.column(0)), stream(batch.column(1)), strict=True):
                if text:
                    codes, n = gram_counts(text)
                    held.setdefault(lang, []).append((codes, n))
                    size[lang] = size.get(lang, 0) + len(codes)
                    if size[lang] > CODES and len(sum_up(lang)[0]) > CODES:
                        yield flush(lang)
        for lang in list(held):
            yield flush(lang)
        tidy()

    rows = docs.filter(train & col(lang_col).isNotNull()).select(col(lang_col).alias("lang"), col(text_col).alias("text"))
    sums = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    salted = sums.withColumn("salt", F.pmod(F.xxhash64("code"), F.lit(salts)))
    first = salted.withColumn("r", F.row_number().over(W.partitionBy("lang", "salt").orderBy(F.desc("n"), "code"))).filter(F.col("r") <= size)
    by: dict[str, list] = {}
    with modest_batches(docs.sparkSession):
        found = first.select("lang", "code", "n").collect()
    for lang, code, n in found:
        by.setdefault(lang, []).append((-n, code))
    return {lang: [code for _, code in sorted(grams)[:size]] for lang, grams in by.items()}


def _labelled(docs: DataFrame, row: Column, text: Column, known: dict[str, list[int]], size: int) -> DataFrame:
    """(row, lang_pred, score) of each row of docs, whose columns travel inside the struct ``row``."""
    names = sorted(known)

    def label(batches):
        import numpy as np
        import pyarrow as pa

        # One sorted list of all profiled n-grams; row i of ranks has their ranks in language i, or size.
        grams = np.array(sorted({c for p in known.values() for c in p}), np.int64)
        ranks = np.full((len(names), len(grams) + 1), size, np.int64)
        for i, lang in enumerate(names):
            ranks[i, np.searchsorted(grams, np.array(known[lang], np.int64))] = np.arange(len(known[lang]))
        for batch in batches:
            langs, scores = [], []
            for text in stream(batch.column(1)):
                codes, n = gram_counts(text) if text and names else ((), ())
                if len(codes) < 2:  # blanks alone make one
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                top = _top(codes, n, size)
                at = np.searchsorted(grams, top)
                at[grams[np.minimum(at, len(grams) - 1)] != top] = len(grams)
                own = ranks[:, at]
                apart = np.where(own == size, size, np.abs(own - np.arange(len(top)))).sum(1)
                i = int(apart.argmin())
                langs.append(names[i])
                scores.append(1.0 - float(apart[i]) / (size * len(top)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])
        tidy()

    given = docs.select(row, text.alias("text"))
    return given.mapInArrow(label, T.StructType([given.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify(docs: DataFrame, known: dict[str, list[int]], text_col: str = "text", keep: list[str] | None = None, size: int = 400) -> DataFrame:
    """``keep`` columns (default: all) with lang_pred and score.

    A text that is null or has no letter gets "und" with score 0, as does every text if there are no profiles.
    Otherwise score is one minus the distance over the greatest possible distance, so 0 to 1. Equal distances go to
    the language first in order of name. Empty and very long texts are taken whole, these in stretches; null and repeated
    ids are answered row by row. Columns called lang_pred or score are replaced, all others pass unchanged. Lang,
    source and id are never looked at.
    """
    docs_ = docs.select(*map(col, keep)) if keep else docs
    return opened(_labelled(docs, whole(docs_, ("lang_pred", "score")), col(text_col), known, size), F.col("lang_pred"), F.col("score"))


def fold(id_: Column, folds: int) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds))


def op6_langid(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    out = settle(identify(docs, profiles(docs, ~held), keep=["doc_id"]), "languages")
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, train: Column | None = None, least_score: float = LEAST_SCORE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """docs in their own columns, ``lang_col`` now the language found, without the rows whose language can't be told.

    Those have no letter, or a score below ``least_score``: their n-grams are too far from every language learned. With
    no language learned at all, every row goes. The profiles are learned from the rows where train holds (default: all).
    """
    known = profiles(docs, F.lit(True) if train is None else train, lang_col, text_col)
    out = _labelled(docs, whole(docs), col(text_col), known, 400).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score))
    return opened(out.withColumn("row", F.col("row").withField("`" + lang_col.replace("`", "``") + "`", F.col("lang_pred"))))
