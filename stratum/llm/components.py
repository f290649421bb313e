"""Connected components: union-find inside tasks, then alternating stars across them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.scratch import settle

TASK_EDGES = 500_000  # that one task joins by union-find


def contract(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of a task replaced by (node, smallest node of its set), by union-find over that task's edges."""

    def run(batches):
        import pyarrow as pa

        parent: dict[int, int] = {}

        def root(x):
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while (up := parent[x]) != top:
                parent[x], x = top, up
            return top

        def flush():
            nodes = [x for x in parent if root(x) != x]
            out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])
            parent.clear()
            return out

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 1_000_000:  # bounded memory: the stars below join what is cut here
                yield flush()
        yield flush()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _least(edges: DataFrame) -> DataFrame:
    """(_k, m): each node's smallest neighbour or itself. The key is made anew so that joins exchange both sides."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.expr("u ^ cast(0 as bigint)").alias("_k"), F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component, for every node that has an edge (u, v), u <> v.

    As many tasks as have TASK_EDGES edges each run union-find; one task's sets are the answer, those of several meet
    in rounds. Each round links every node's larger neighbours to its smallest (large star), then all its smaller ones (small
    star); rounds grow with the logarithm of a component's size. Each round is written to the shared folder.
    """
    parts = edges.count() // TASK_EDGES + 1
    edges = contract(edges.coalesce(parts))
    edges = settle(edges if parts == 1 else edges.distinct(), "stars")
    while parts > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), F.col("u") == F.col("_k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large, "large")
        small = large.join(_least(large), F.col("u") == F.col("_k"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        small = settle(small, "small")
        # Done when every node has one edge and no root has any.
        state = small.groupBy("u").agg(F.count("*").alias("n"))
        more = state.filter("n > 1").limit(1).count() or small.select("v").distinct().join(small.select(F.col("u").alias("x")), F.col("v") == F.col("x"), "left_semi").limit(1).count()
        edges = small
        if not more:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
