"""The recommendation funnel: routes, merge, quota, fusion, ranking, fallback; and its diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .temporal import top_k


def union_routes(routes: dict[str, DataFrame]) -> DataFrame:
    """All candidates (user, item, score) with their route and its place in the order of routes; nothing is merged."""
    parts = [df.select("user", "item", "score", F.lit(name).alias("route"), F.lit(i).alias("route_no")) for i, (name, df) in enumerate(routes.items())]
    return reduce(DataFrame.unionByName, parts)


def merge_best(candidates: DataFrame) -> DataFrame:
    """One row per user and item: the best score; on equal scores the earlier route."""
    best = F.max_by(F.struct("score", "route", "route_no"), F.struct("score", -F.col("route_no"))).alias("_b")
    return candidates.groupBy("user", "item").agg(best).select("user", "item", "_b.*")


def quota(candidates: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The best of each route up to its quota."""
    ranked = top_k(candidates, ["user", "route"], max(limits.values()), F.desc("score"), F.col("item"))
    allowed = reduce(lambda a, b: a | b, [(F.col("route") == r) & (F.col("rank") <= n) for r, n in limits.items()])
    return ranked.where(allowed).drop("rank")


def recommend(users: DataFrame, candidates: DataFrame, hot: list, limit: int, overloaded: str | None = None, late: str | None = None) -> DataFrame:
    """Per user: items by (-score, item), or the hot list with ``degraded`` and a reason.

    ``overloaded`` and ``late`` are boolean columns of ``users``.  A user without candidates gets an empty list.
    """
    best = top_k(merge_best(candidates), ["user"], limit, F.desc("score"), F.col("item"))
    lists = best.groupBy("user").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("own"))
    reason = F.lit(None).cast("string")
    if late:
        reason = F.when(F.col(late), F.lit("timeout")).otherwise(reason)
    if overloaded:
        reason = F.when(F.col(overloaded), F.lit("overload")).otherwise(reason)
    hot_list = F.array(*[F.lit(x) for x in hot[:limit]])
    out = users.join(lists, "user", "left").withColumn("reason", reason)
    own = F.coalesce("own", F.slice(hot_list, 1, 0))
    return out.select("user", F.when(F.col("reason").isNull(), own).otherwise(hot_list).alias("items"), F.col("reason").isNotNull().alias("degraded"), "reason")


def linear_fusion(scores: DataFrame, weights: dict[str, float], out: str = "fused") -> DataFrame:
    return scores.withColumn(out, reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()]))


def weighted_criteria(long: DataFrame, weights: DataFrame, key: str, dim: str, score: str, profile: str, weight: str) -> DataFrame:
    """Weighted mean score of each key under each profile."""
    return long.join(F.broadcast(weights), dim).groupBy(profile, key).agg((F.sum(F.col(weight) * F.col(score)) / F.sum(weight)).alias("total"))


def position_weights(position: Column) -> tuple[Column, Column]:
    """1/i and e^-(i-1) for a position i from 1."""
    return 1.0 / position, F.exp(-(position - 1.0))


def over_scan(edges: DataFrame, visible: DataFrame, limit: int, factor: int = 5, most: int = 1000) -> DataFrame:
    """Neighbours with an over-scan: the best ``min(most, factor * limit)`` edges first, then invisible items leave, then
    the limit.  The filter must not move below the first limit."""
    wide = top_k(edges, ["src"], min(most, factor * limit), F.desc("weight"), F.col("dst"), out="_r")
    return top_k(wide.join(visible.select(F.col("item").alias("dst")), "dst", "left_semi").drop("_r"), ["src"], limit, F.desc("weight"), F.col("dst"))


def neighbour_query(queries: DataFrame, edges: DataFrame, visible: DataFrame, version: int, limit: int = 200) -> DataFrame:
    """Answers to (query, src, want, min_version): degraded when the limit is above 200 or the graph is too old."""
    bad = (F.col("want") > limit) | (F.lit(version) < F.col("min_version"))
    q = queries.withColumn("degraded", bad)
    found = over_scan(edges.join(q.where("not degraded").select("src").distinct(), "src", "left_semi"), visible, limit)
    rows = q.where("not degraded").join(found, "src").where("rank <= want")
    lists = rows.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]).alias("items"))
    return q.join(lists, "query", "left").select("query", "degraded", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def feature_costs(df: DataFrame, feature: str, parts: list[str], latency: str, unit: float, gain: str) -> DataFrame:
    """Total cost, gain per cost, quadrant by upper medians, and each feature's share of all cost."""
    total = reduce(lambda a, b: a + b, [F.col(p) for p in parts]) + F.col(latency) * unit
    base = df.select(feature, total.alias("cost"), F.col(gain).alias("gain"))
    mid = base.agg(upper_median(F.col("cost")).alias("mc"), upper_median(F.col("gain")).alias("mg"), F.sum("cost").alias("all"))
    out = base.crossJoin(F.broadcast(mid))
    high_gain, high_cost = F.col("gain") >= F.col("mg"), F.col("cost") >= F.col("mc")
    quadrant = F.concat(F.when(high_gain, "high").otherwise("low"), F.lit("_gain_"), F.when(high_cost, "high").otherwise("low"), F.lit("_cost"))
    return out.select(feature, "cost", "gain", (F.col("gain") / F.col("cost")).alias("roi"), quadrant.alias("quadrant"), (F.col("cost") / F.col("all")).alias("share"))


def upper_median(x: Column) -> Column:
    """The element at half the count of the sorted values, the larger of the middle two."""
    return F.get(F.array_sort(F.collect_list(x)), F.floor(F.count(x) / 2).cast("int"))


def simulate_serving(loads: DataFrame, timeout_ms: int) -> DataFrame:
    """Overload and timeout arithmetic for (requests, capacity, dependency_ms) rows, p99 by index into the sorted list.

    The list has ``personalized`` times the dependency latency and the rest at min(timeout, 5), so its element at an
    index follows from the two counts without building it.
    """
    served = F.least("requests", "capacity")
    timed_out = F.when(F.col("dependency_ms") > timeout_ms, served).otherwise(0)
    quick = F.lit(min(timeout_ms, 5))
    base = loads.withColumn("personalized", served - timed_out).withColumn("fallback", F.col("requests") - F.col("personalized"))
    at = F.least(F.col("requests") - 1, F.greatest(F.lit(0), F.floor(F.col("requests") * F.lit(0.99)) - 1))
    low = F.least(F.col("dependency_ms"), quick)
    low_count = F.when(F.col("dependency_ms") <= quick, F.col("personalized")).otherwise(F.col("fallback"))
    p99 = F.when(at < low_count, low).otherwise(F.greatest(F.col("dependency_ms"), quick))
    return base.select("*", (F.col("fallback") / F.greatest(F.col("requests"), F.lit(1))).alias("fallback_rate"), p99.alias("p99_ms"))


def upper_index_quantile(values: Column, q: float) -> Column:
    """Element max(0, int(n * q) - 1) of the sorted values."""
    n = F.count(values)
    return F.get(F.array_sort(F.collect_list(values)), F.greatest(F.lit(0), F.floor(n * q) - 1).cast("int"))
