"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation by vertex and a join back; a vertex with very many neighbours is pre-aggregated and its
join is one that Spark can split.  Each round is written to the shared folder, so lineage stays short and a lost
executor costs one round at most.  Once no more than LOCAL_EDGES are left, which is any small table's case from the start, one
task joins them by union-find instead of further rounds, each of which takes eight stages.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Edges that one worker holds, 16 bytes each and the ends in a dictionary.
LOCAL_EDGES = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over undirected edges (u, v), u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where(F.col("u") > F.col("v")).distinct()


def _joined(edges: DataFrame) -> DataFrame:
    """(id, component_id) of at most LOCAL_EDGES edges (u, v), in one task."""

    def work(batches):
        root: dict[int, int] = {}

        def find(x):
            top = x
            while root[top] != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                root.setdefault(u, u)
                root.setdefault(v, v)
                a, b = find(u), find(v)
                root[max(a, b)] = min(a, b)
        ids = list(root)
        columns = [pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "component_id"])

    return edges.coalesce(1).mapInArrow(work, "id long, component_id long")


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for every end of ``links`` (a, b); component_id is the smallest id reachable.

    Self links and repeated links are harmless; no links give an empty table.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = settle(edges.distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] <= LOCAL_EDGES:
            return _joined(edges)
        if mark == seen:
            break
        seen = mark
        edges = settle(_star(_star(edges, True), False), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    )
