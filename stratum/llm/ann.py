"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are dealt to the cells of a coarse quantizer. What is left of a vector beyond its cell's centre is rotated by a
seeded random rotation and kept as its signs, packed, with two scalars: its length, and the inner product of its
direction with its own code. From the packed bits and these a query estimates its distance to every vector of a cell,
with an error bound; only vectors whose lower bound can still reach the best upper bounds are compared exactly.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.llm.columns import col
from stratum.llm.scratch import documents, settle


class Quantizer:
    """Centres and rotation of one dimension, fitted on a bounded sample (without one: the origin); at most ``cells`` * dim + dim^2 numbers, sent to the tasks."""

    def __init__(self, sample, cells: int, seed: int, steps: int = 10):
        import numpy as np

        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype("f4")
        distinct = np.unique(sample, axis=0) if len(sample) else np.zeros((1, dim))
        self.centres = distinct[rng.permutation(len(distinct))[:cells]].astype("f4")
        for _ in range(steps):
            near = self.nearest(distinct)
            sums = np.stack([np.bincount(near, distinct[:, i], len(self.centres)) for i in range(dim)], 1)
            n = np.bincount(near, minlength=len(self.centres))
            self.centres[n > 0] = (sums[n > 0] / n[n > 0, None]).astype("f4")

    def far(self, x):
        """Squared distance of each row to each centre, up to a term of the row's own."""
        return (self.centres.astype("f8") ** 2).sum(1) - 2 * (x @ self.centres.T)

    def nearest(self, x):
        import numpy as np

        return np.concatenate([self.far(x[i : i + 4096]).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)

    def encode(self, x):
        """(cell, packed signs, length, direction . code) of each row."""
        import numpy as np

        cell = self.nearest(x)
        left = (x - self.centres[cell]).astype("f4")
        length = np.sqrt((left.astype("f8") ** 2).sum(1))
        turned = (left @ self.rotation) / np.maximum(length, 1e-30)[:, None]
        dot = np.abs(turned).sum(1) / np.sqrt(x.shape[1])
        return cell, np.packbits(turned > 0, axis=1), length, np.where(length > 0, dot, 1.0)

    def bounds(self, q, cell: int, bits, length, dot, eps: float):
        """Lower and upper bounds of the squared distances of queries (rows) to coded vectors (columns)."""
        import numpy as np

        dim = q.shape[1]
        off = (q - self.centres[cell]).astype("f4")
        own = np.sqrt((off.astype("f8") ** 2).sum(1))[:, None]
        # A query's sums of signed parts for all 256 values of each byte of a code, then one look-up per byte.
        turned = np.zeros((len(q), 8 * bits.shape[1]), "f4")
        turned[:, :dim] = off @ self.rotation
        signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype("f4") * 2 - 1
        sums = turned.reshape(len(q), -1, 8) @ signs.T
        inner = np.zeros((len(q), len(bits)), "f8")
        for byte in range(bits.shape[1]):
            inner += sums[:, byte][:, bits[:, byte]]
        inner /= np.sqrt(dim) * dot
        slack = own * (eps * np.sqrt(np.maximum(0, 1 - dot**2)) / (dot * np.sqrt(max(1, dim - 1))))
        base = length**2 + own**2
        return base - 2 * length * (inner + slack), base - 2 * length * (inner - slack)


def _matrix(column, dim: int, dtype: str):
    """Rows of a column of equally long binaries."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector that is not empty, not all zero, and without nulls, NaN or infinities."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(col(id_col).cast("long").alias("id"), col(vec_col).alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & fine)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = 20_000, probes: float = 0.6, least_probes: int = 16, eps: float = 3.0, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by Euclidean distance in double precision.

    Candidates are all usable rows of ``vectors`` of the query's dimension whose id is not the query's; see ``usable`` for
    those that take no part, on either side. Nearest first, ties to the smaller id; all candidates, if there are fewer
    than k. Every usable row is coded; quantizers are fitted, one for each dimension, on at most ``sample`` rows in all,
    first by a hash of the id, and on at most a quarter as many cells. A query visits the nearest ``probes`` share of its
    dimension's cells, and more while these hold no k + 1 rows. A cell with many rows is cut into blocks that are searched
    apart, so a vector repeated very often burdens no single task. Rows that repeat an id are candidates of their own,
    queries that repeat id and vector are answered once. Empty tables give an empty result. Columns other than id and
    vector are not read.
    """
    rows = usable(vectors, id_col, vec_col)
    kind = "f8" if "double" in rows.schema["v"].dataType.simpleString() else "f4"
    first = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    if not first:
        return spark.createDataFrame([], result)
    import numpy as np

    sizes = {r[0]: r[1] for r in rows.groupBy(F.size("v")).count().collect()}  # a row for each dimension
    by_dim: dict[int, list] = {d: [] for d in sizes}
    for r in first:
        by_dim[len(r[1])].append(r[1])
    quantizers = {d: Quantizer(np.array(by_dim[d], "f8").reshape(-1, d), max(1, min(sample // 4, round(n**0.5 / 4))), seed) for d, n in sizes.items()}
    # Cells of all dimensions have one numbering.
    begin, total = {}, 0
    for d, q in quantizers.items():
        begin[d], total = total, total + len(q.centres)
    dim_of = [d for d, q in quantizers.items() for _ in q.centres]

    def parts(batch):
        """(dimension, rows of the batch, matrix) for each dimension in a batch of (id, vector)."""
        wide = batch.column(1)
        at, values = wide.offsets.to_numpy(), wide.values.to_numpy(zero_copy_only=False)
        lengths = np.diff(at)
        for d in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == d)
            yield d, own, values[at[own][:, None] + np.arange(d)]

    def code(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for d, own, x in parts(batch):
                cell, bits, length, dot = quantizers[d].encode(x)
                raw = np.ascontiguousarray(x.astype(kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((cell + begin[d]).astype("i4")), batch.column(0).take(pa.array(own)), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(dot)],
                    ["cell", "vec_id", "raw", "bits", "length", "dot"],
                )

    coded = settle(rows.mapInArrow(code, "cell int, vec_id long, raw binary, bits binary, length double, dot double"), "codes")
    held = {r[0]: r[1] for r in coded.groupBy("cell").count().collect()}  # a row for each cell
    block = {d: max(block_rows, n // (4 * len(quantizers[d].centres))) for d, n in sizes.items()}
    blocks = [-(-held.get(c, 0) // block[dim_of[c]]) for c in range(total)]

    def probe(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for d, own, x in parts(batch):
                if d not in quantizers:
                    continue
                count = np.array([held.get(begin[d] + c, 0) for c in range(len(quantizers[d].centres))])
                visits = max(least_probes, round(len(count) * probes))
                at, cell, part = [], [], []
                for i, row in zip(own.tolist(), np.argsort(quantizers[d].far(x), axis=1, kind="stable"), strict=True):
                    row = row[count[row] > 0]
                    stop = max(visits, int(np.searchsorted(np.cumsum(count[row]), k + 1)) + 1)
                    for c in (row[:stop] + begin[d]).tolist():
                        for b in range(blocks[c]):
                            at.append(i)
                            cell.append(c)
                            part.append(b)
                raw = pa.array([r.tobytes() for r in np.ascontiguousarray(x.astype(kind))], pa.binary())
                place = np.searchsorted(own, at)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(part, pa.int32()), batch.column(0).take(pa.array(at, pa.int64())), raw.take(pa.array(place, pa.int64()))], ["cell", "part", "query_id", "raw"])

    asked = queries.select(col(id_col).cast("long").alias("id"), col(vec_col).alias("v"))
    asked = usable(asked, "id", "v").dropDuplicates(["id", "v"])
    visiting = asked.mapInArrow(probe, "cell int, part int, query_id long, raw binary")
    splits = F.get(F.from_json(F.lit(json.dumps(blocks)), F.lit("array<int>")), F.col("cell"))
    dealt = coded.withColumn("part", F.pmod(F.xxhash64("vec_id", "raw", F.lit(seed)), F.greatest(splits, F.lit(1))).cast("int"))

    def nearest(key, there, asking):
        import numpy as np
        import pyarrow as pa

        out = ([], [], [], [])
        if there.num_rows and asking.num_rows:
            cell = key[0].as_py()
            dim = dim_of[cell]
            quantizer = quantizers[dim]
            x = _matrix(there.column("raw"), dim, kind).astype("f8")
            ids = there.column("vec_id").to_numpy()
            bits = _matrix(there.column("bits"), -(-dim // 8), "u1")
            length, dot = there.column("length").to_numpy(), there.column("dot").to_numpy()
            qs, raws = asking.column("query_id").to_numpy(), asking.column("raw").to_pylist()
            q = _matrix(asking.column("raw"), dim, kind).astype("f8")
            step = max(1, 8_000_000 // len(x))
            for s in range(0, len(q), step):
                low, high = quantizer.bounds(q[s : s + step], cell - begin[dim], bits, length, dot, eps)
                for i in range(len(low)):
                    other = ids != qs[s + i]
                    reach = high[i][other]
                    if not len(reach):
                        continue
                    limit = np.partition(reach, k - 1)[k - 1] if len(reach) > k else np.inf
                    look = np.flatnonzero(other & (low[i] <= limit))
                    score = np.sqrt(((x[look] - q[s + i]) ** 2).sum(1))
                    best = np.lexsort((ids[look], score))[:k]
                    out[0].extend([int(qs[s + i])] * len(best))
                    out[1].extend([raws[s + i]] * len(best))
                    out[2].extend(ids[look][best].tolist())
                    out[3].extend(score[best].tolist())
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.float64()), strict=True)], ["query_id", "raw", "vec_id", "score"])

    found = dealt.groupBy("cell", "part").cogroup(visiting.groupBy("cell", "part")).applyInArrow(nearest, "query_id long, raw binary, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "raw").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark, sf_dir):
    vectors = documents(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))
