"""Positions and running sums in one global order, without a window that is a single task.

Rows are dealt to ranges of the order column by quantiles of it; a window runs within each range, and what the ranges
before hold, a table of one row per range, is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges the order is cut into; the quantiles are the only thing that reaches the driver.
RANGES = 256


def running(df: DataFrame, order: str, sums: dict[str, Column], ties: list[str] | None = None, descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """``df`` with a column for each of ``sums``: the sum of its expression up to and including the row.

    ``order`` is a number that is not null; rows with an equal one are in one range, in the order of ``ties``.
    """
    cuts = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)]).alias("c")).first()["c"] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    above = F.size(F.filter(bounds, lambda b: b < F.col(order).cast("double")))
    sign = F.desc if descending else F.asc
    ranged = df.withColumn("_range", -above if descending else above)
    inner = W.partitionBy("_range").orderBy(sign(order), *(ties or [])).rowsBetween(W.unboundedPreceding, W.currentRow)
    names = {n: f"_own_{i}" for i, n in enumerate(sums)}
    own = ranged.withColumns({names[n]: F.sum(e).over(inner) for n, e in sums.items()})
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    held = ranged.groupBy("_range").agg(*[F.sum(e).alias(f"_held_{i}") for i, e in enumerate(sums.values())])
    held = held.select(F.col("_range"), *[F.coalesce(F.sum(f"_held_{i}").over(before), F.lit(0)).alias(f"_before_{i}") for i in range(len(sums))])
    joined = own.join(F.broadcast(held), "_range")
    return joined.select(*df.columns, *[(F.col(names[n]) + F.col(f"_before_{i}")).alias(n) for i, n in enumerate(sums)])
