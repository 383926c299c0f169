"""Directed graphs as (src, dst): frontier, neighbours, cycles, integrity, co-occurrence, walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import blocks, walks
from .temporal import bounded_history


def frontier(nodes: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """Nodes not done whose prerequisites are all done: two anti joins."""
    unmet = edges.join(done.select(F.col("id").alias("src")), "src", "left_anti").select(F.col("dst").alias("id"))
    return nodes.join(done.select("id"), "id", "left_anti").join(unmet, "id", "left_anti")


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, other, relation): what each id needs and what needs it."""
    before = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("prerequisite").alias("relation"))
    after = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("downstream").alias("relation"))
    return before.unionByName(after).join(ids, "id", "left_semi")


def neighbourhood(edges: DataFrame, group: DataFrame) -> DataFrame:
    """Around a set of ids: inner edges, and how many outside ids stand before and after."""
    inside = group.select("id")
    into = edges.join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out = edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi")
    inner = into.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").agg(F.count("*").alias("inner_edges"))
    before = into.join(inside.withColumnRenamed("id", "src"), "src", "left_anti").agg(F.countDistinct("src").alias("before"))
    after = out.join(inside.withColumnRenamed("id", "dst"), "dst", "left_anti").agg(F.countDistinct("dst").alias("after"))
    return inner.crossJoin(before).crossJoin(after)


def on_cycles(edges: DataFrame) -> DataFrame:
    """Edges left after peeling: sources and sinks are removed until none is left, so an acyclic graph leaves nothing.

    Rounds go on until one removes nothing; each is written to the shared folder, where its lineage ends.
    """
    left = edges.select("src", "dst").distinct()
    n = left.count()
    while True:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        path = scratch_path(left.sparkSession, "cycles")
        kept.write.parquet(path)
        kept = left.sparkSession.read.schema(kept.schema).parquet(path)
        m = kept.count()
        if m == n or m == 0:
            return kept
        left, n = kept, m


def integrity(nodes: DataFrame, edges: DataFrame, cards: DataFrame) -> DataFrame:
    """(problem, id): edge ends that are no node, nodes without a card, cards without a node."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    parts = [
        ends.join(nodes, "id", "left_anti").select(F.lit("edge_end_unknown").alias("problem"), "id"),
        nodes.join(cards, "id", "left_anti").select(F.lit("card_missing").alias("problem"), "id"),
        cards.join(nodes, "id", "left_anti").select(F.lit("node_missing").alias("problem"), "id"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as Mermaid text in one row: sorted edges, then isolated nodes.  For small graphs."""
    lines = edges.select(F.lit(0).alias("o"), F.concat(F.lit("  "), "src", F.lit(" --> "), "dst").alias("line"))
    lines = lines.unionByName(isolated(nodes, edges).select(F.lit(1).alias("o"), F.concat(F.lit("  "), "id").alias("line")))
    body = lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]).alias("l"))
    return body.select(F.concat(F.lit("graph TD\n"), F.array_join("l", "\n")).alias("text"))


def cooccurrence(actions: DataFrame, user: str, item: str, order: list[str], window: int = 50, event: str = "event_id") -> DataFrame:
    """Edges between an action's item and each different item of the user's last ``window`` actions, both ways, weighted
    by the number of distinct events."""
    hist = bounded_history(actions, [user], order, item, window, "_h")
    pairs = hist.select(event, F.col(item).alias("a"), F.explode(F.array_distinct("_h")).alias("b")).where("a != b")
    both = pairs.select(event, F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(event, F.col("b").alias("src"), F.col("a").alias("dst")))
    return both.groupBy("src", "dst").agg(F.countDistinct(event).alias("weight"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, steps: int = 3, restart: float = 0.15) -> DataFrame:
    """(seed, id, score) after a fixed number of power steps; the published definition, mass without an out-edge restarts."""
    degree = edges.groupBy("src").agg(F.sum("weight").alias("_d"))
    moves = edges.join(degree, "src").select(F.col("src").alias("id"), "dst", (F.col("weight") / F.col("_d")).alias("p"))
    now = seeds.select("seed", F.col("seed").alias("id"), F.lit(1.0).alias("score"))
    if blocks.fits(edges, "src", "dst") and blocks.fits(seeds, "seed"):
        return _walked(blocks.settled(moves.withColumnRenamed("id", "src"), "moves"), now, steps, 1 - restart)
    for _ in range(steps):
        moved = now.join(moves, "id").groupBy("seed", F.col("dst").alias("id")).agg((F.sum(F.col("score") * F.col("p")) * (1 - restart)).alias("score"))
        lost = moved.groupBy("seed").agg((1 - F.sum("score")).alias("score")).select("seed", F.col("seed").alias("id"), "score")
        now = moved.unionByName(lost).groupBy("seed", "id").agg(F.sum("score").alias("score"))
    return now


def _walked(moves: DataFrame, now: DataFrame, steps: int, keep: float) -> DataFrame:
    """The steps of ``personalised_pagerank`` on integers; all but the last are settled.

    The shares of a node's edges sum to 1, so what a seed has moved is read off its nodes that have an edge.
    """
    some = moves.where("dst is not null and p is not null")
    nowhere = moves.where("dst is null and p is not null")
    kinds = now.schema["seed"].dataType, moves.schema["dst"].dataType
    ids = kinds[0] if kinds[0] == kinds[1] else "long"
    starts = moves.where("p is not null").select(F.col("src").alias("id")).distinct()
    for i in range(steps):
        now = now.where("seed is not null and id is not null")
        lost = now.join(starts, "id", "left_semi").groupBy("seed").agg((1 - F.sum("score") * keep).alias("score"))
        moved = walks.step(now, some, lost, keep)
        if i < steps - 1:
            moved = blocks.settled(moved, "walk")
        elif not nowhere.isEmpty():  # edges to null are reached too, but lead no further
            end = now.join(nowhere, now.id == nowhere.src).groupBy("seed").agg((F.sum(F.col("score") * F.col("p")) * keep).alias("score"))
            moved = moved.unionByName(end.select("seed", F.lit(None).cast("long").alias("id"), "score"))
        now = moved
    return now.select(F.col("seed").cast(kinds[0]).alias("seed"), F.col("id").cast(ids).alias("id"), "score")
