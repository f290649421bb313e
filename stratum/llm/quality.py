"""Quality classification by a generalised additive model with pairwise interactions.

Features of the text alone are cut into quantile bins. Boosting cycles over the features: each step fits one shallow
tree on one feature's bins and adds it to that feature's lookup table; then the pairs with the strongest joint signal
left get two-way tables in the same way. A score is the logistic of an intercept and a sum of table entries, taken by
vectorised bin additions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.columns import col
from stratum.llm.langid import fold
from stratum.llm.scratch import documents, settle
from stratum.llm.words import stretches
from stratum.llm.workers import stream, tidy

STRETCH = 4_000_000  # bytes of a long text that are worked through at once
FEATURES = (
    "bytes", "words", "word_bytes", "longest_word", "upper_of_letters", "letters", "digits", "spaces", "newlines", "full_stops", "commas", "bangs", "bars", "signs", "other_marks",
    "other_bytes", "distinct_words", "top_word", "repeated_neighbours", "distinct_lines", "words_end_in_sign", "capital_words", "entropy",
)


def text_features(text: str | None) -> list[float]:
    """FEATURES of a whole text; a null or empty one has zeros. A long text is worked through in stretches of whole words."""
    import numpy as np

    data = (text or "").encode("utf-8", "surrogatepass")
    n, m = len(data), 0
    c = np.zeros(256, np.int64)
    seen: dict[bytes, int] = {}
    lines: set[bytes] = set()
    n_lines = word_bytes = longest = neighbours = ends = capitals = 0
    before = None
    for part in stretches(data, STRETCH, 0):
        c += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        words = part.split()
        if not words:
            continue
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        m += len(words)
        word_bytes += sum(map(len, words))
        longest = max(longest, max(map(len, words)))
        neighbours += sum(map(bytes.__eq__, words, words[1:])) + (before == words[0])
        before = words[-1]
        ends += sum(w[-1] in b"#$%&*!|" for w in words)
        capitals += sum(65 <= w[0] <= 90 for w in words)
    if not m:
        return [float(np.log1p(n))] + [0.0] * (len(FEATURES) - 1)
    begin = 0
    while begin <= n:
        stop = data.find(b"\n", begin)
        stop = n if stop < 0 else stop
        line = data[begin:stop]
        lines.add(line if len(line) <= 64 else hashlib.blake2b(line, digest_size=16).digest())
        n_lines, begin = n_lines + 1, stop + 1
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    marks = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
    signs = int(c[[35, 36, 37, 38, 42, 64, 94, 126]].sum())
    p = c[c > 0] / n
    return [
        float(np.log1p(n)), float(np.log1p(m)), word_bytes / m, float(np.log1p(longest)), upper / max(1, upper + lower), (upper + lower) / n, int(c[48:58].sum()) / n, int(c[32]) / n,
        int(c[10]) / n, int(c[46]) / m, int(c[44]) / m, int(c[33]) / m, int(c[124]) / m, signs / m, (marks - signs - int(c[46] + c[44] + c[33] + c[124])) / m,
        int(c[128:].sum()) / n, len(seen) / m, max(seen.values()) / m, neighbours / m, len(lines) / n_lines, ends / m,
        capitals / m, float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Model:
    """intercept, one table per feature, and two-way tables of coarser bins for the chosen pairs."""

    edges: list
    coarse: list
    intercept: float
    tables: list
    pairs: list = field(default_factory=list)

    def score(self, x):
        import numpy as np

        margin = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            margin += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        if self.pairs:
            bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.coarse)]
            for i, j, table in self.pairs:
                margin += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _edges(column, bins: int):
    import numpy as np

    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _tree(g, h, leaves: int, ridge: float, least: float):
    """Step values on ordered bins of a tree with at most ``leaves`` leaves, grown by the best cut each time."""
    import numpy as np

    spans, out = [(0, len(g))], np.zeros(len(g))
    cg, ch = np.concatenate(([0], g.cumsum())), np.concatenate(([0], h.cumsum()))

    def gain(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)

    while len(spans) < leaves:
        best = (1e-9, None, None)
        for s, (a, b) in enumerate(spans):
            cuts = np.arange(a + 1, b)
            cuts = cuts[(ch[cuts] - ch[a] >= least) & (ch[b] - ch[cuts] >= least)]
            if len(cuts):
                gains = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                k = int(gains.argmax())
                if gains[k] > best[0]:
                    best = (gains[k], s, int(cuts[k]))
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    for a, b in spans:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _quarters(g, h, ridge: float):
    """(gain, row cut, column cut, four values) of the best cut of a two-way table into quarters."""
    import numpy as np

    cg, ch = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    a, b = (m[1:-1, 1:-1] for m in (cg, ch))
    if not a.size:
        return 0.0, 0, 0, (0, 0, 0, 0)
    sums = [(m[1:-1, 1:-1], m[1:-1, -1:] - m[1:-1, 1:-1], m[-1:, 1:-1] - m[1:-1, 1:-1], m[-1, -1] - m[1:-1, -1:] - m[-1:, 1:-1] + m[1:-1, 1:-1]) for m in (cg, ch)]
    gains = sum(p**2 / (q + ridge) for p, q in zip(*sums, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    k = np.unravel_index(int(gains.argmax()), gains.shape)
    return float(gains[k]), int(k[0]) + 1, int(k[1]) + 1, tuple(float(p[k] / (q[k] + ridge)) for p, q in zip(*sums, strict=True))


def fit(x, y, bins: int = 48, rounds: int = 120, leaves: int = 3, rate: float = 0.15, pairs: int = 6, pair_bins: int = 12, pair_rounds: int = 40, ridge: float = 1.0, least: float = 1.0) -> Model:
    """Fits on a matrix of features and 0/1 labels; one class or no rows give a constant model."""
    import numpy as np

    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    edges, coarse = ([_edges(x[:, f], k) if n else np.zeros(0) for f in range(width)] for k in (bins, pair_bins))
    model = Model(edges, coarse, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges])
    if n == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(width)]
    margin = np.full(n, model.intercept)

    def slope():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            g, h = slope()
            k = len(edges[f]) + 1
            step = rate * _tree(np.bincount(at[f], g, k), np.bincount(at[f], h, k), leaves, ridge, least)
            model.tables[f] += step
            margin += step[at[f]]

    low = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(width)]
    shape = [len(e) + 1 for e in coarse]

    def two_way(i, j, v):
        return np.bincount(low[i] * shape[j] + low[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = slope()
    strength = sorted(((_quarters(two_way(i, j, g), two_way(i, j, h), ridge)[0], i, j) for i in range(width) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((shape[i], shape[j]))) for s, i, j in strength[:pairs] if s > 0]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = slope()
            _, r, c, values = _quarters(two_way(i, j, g), two_way(i, j, h), ridge)
            for (rows, cols), v in zip(((slice(r), slice(c)), (slice(r), slice(c, None)), (slice(r, None), slice(c)), (slice(r, None), slice(c, None))), values, strict=True):
                table[rows, cols] += rate * v
                margin += rate * v * np.isin(low[i], np.arange(shape[i])[rows]) * np.isin(low[j], np.arange(shape[j])[cols])
    return model


def featurize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features array<float>), from whole texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [text_features(t) for t in stream(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], ["id", "features"])
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(run, f"id {kind}, features array<float>")


def train(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = 20_000) -> Model:
    """Fits on at most ``sample`` labelled rows, those first in the order of a hash of their id; null labels are left out."""
    import numpy as np

    given = labels.select(col(id_col).alias("_l"), col(label_col).cast("double").alias("y")).filter("y is not null")
    rows = features.join(given, F.col("id") == F.col("_l")).select("features", "y", F.xxhash64("id").alias("h"))
    rows = rows.orderBy("h", "y").limit(sample).collect()
    x = np.array([r[0] for r in rows], np.float32).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r[1] for r in rows]))


def grade(features: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(id, score, predicted) for each row of features."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES)).astype(np.float32)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype("i4"))], ["id", "score", "predicted"])

    return features.mapInArrow(run, f"id {features.schema['id'].dataType.simpleString()}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, may_learn, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, score, predicted) per row of docs; labels count where may_learn (a condition on ``id``) holds.

    Null and empty texts score like any other (their features are zeros); repeated ids are scored row by row; null
    ids are scored and never learned from. Other columns are not read. No labels, or one class, give a constant score.
    """
    features = settle(featurize(docs, id_col, text_col), "features")
    return grade(features, train(features.filter(may_learn), labels, id_col, **options))


def op8_quality(spark, sf_dir):
    held = F.coalesce(fold(F.col("id"), 3) == 1, F.lit(False))
    out = classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), ~held)
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", "predicted")
