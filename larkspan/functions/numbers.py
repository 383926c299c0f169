"""Apportionment and capacity arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def apportion(parts: DataFrame, keys: list[str], total: str, weight: str, order: str, out: str = "share") -> DataFrame:
    """Largest remainder with at least 1 for each part.

    When that minimum leaves nothing over, no part gets more: the rule stays within the total wherever it can.
    """
    all_ = W.partitionBy(*keys)
    raw = F.col(total) * F.col(weight) / F.sum(weight).over(all_)
    df = parts.withColumn("_raw", raw).withColumn("_floor", F.greatest(F.lit(1), F.floor("_raw")))
    df = df.withColumn("_left", F.greatest(F.lit(0), F.col(total) - F.sum("_floor").over(all_)))
    rn = F.row_number().over(all_.orderBy(F.desc(F.col("_raw") - F.floor("_raw")), F.desc(weight), order))
    return df.withColumn(out, (F.col("_floor") + F.when(rn <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_raw", "_floor", "_left")


# The shares of a latency budget in per cent, the rest goes to the last stage.
BUDGET = (("gateway", 5), ("retrieval", 15), ("prerank", 30), ("rank", 30), ("rerank", 5))


def latency_budget(p99: Column) -> Column:
    """Budget of each stage in ms as an array of structs; the last entry is the remainder."""
    parts = [F.struct(F.lit(n).alias("stage"), (p99 * s / 100).alias("ms")) for n, s in BUDGET]
    rest = 100 - sum(s for _, s in BUDGET)
    return F.array(*parts, F.struct(F.lit("reserve").alias("stage"), (p99 * rest / 100).alias("ms")))


def in_flight(qps: Column, p99_ms: Column) -> Column:
    """Requests in flight by Little's law, rounded up."""
    return F.ceil(qps * p99_ms / 1000).cast("long")


def vector_costs(n: Column, d: Column, m: int = 8, gflops: float = 10.0) -> list[Column]:
    """Operations of an exact search, its seconds on one core, and bytes as float32, int8 and product codes."""
    ops = n * d
    return [ops.alias("ops"), (ops / (gflops * 1e9)).alias("seconds"), (n * d * 4).alias("float32"), (n * d).alias("int8"), (n * m).alias("pq")]
