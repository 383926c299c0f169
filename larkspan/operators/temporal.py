"""Operators over ordered rows: latest row, as-of joins, carry-forward, bounded history, snapshots, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key by ``order``: an aggregation with map-side combine, no sort.  Order columns must not tie."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def label_join(features: DataFrame, labels: DataFrame, keys: list[str], label_order: list[Column]) -> DataFrame:
    """Features with the latest label of their keys; rows without one leave."""
    return features.join(latest_by(labels, keys, *label_order), keys)


def asof_join(
    labels: DataFrame,
    features: DataFrame,
    key: str,
    label_ts: str,
    feature_ts: str,
    tie: str,
    available: str | None = None,
    bucket_seconds: int = 86_400,
    max_age_seconds: float | None = None,
) -> DataFrame:
    """Point-in-time join, backward and inclusive: each label row with the last feature row at or before it.

    Labels without such a row leave; of features at one time the least ``tie`` wins.  With ``available`` a feature
    counts from when it arrived, and the one with the latest event time wins.  Rows are sorted within (key, time
    bucket) and the state at the end of earlier buckets is carried in, so a key with very many rows is many tasks'
    work; only one row per bucket meets in the carry.
    """
    fields = [c for c in features.columns if c != key]
    arrives = available or feature_ts
    negative = F.struct(F.col(feature_ts).alias("_o"), (-F.col(tie)).alias("_t"), F.struct(*fields).alias("_v"))
    feed = features.select(key, F.col(arrives).alias("_at"), F.lit(0).alias("_kind"), negative.alias("_f"), F.lit(None).alias("_l"))
    side = labels.select(
        key, F.col(label_ts).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).alias("_f"), F.struct(*[c for c in labels.columns if c != key]).alias("_l")
    )
    both = feed.unionByName(side).withColumn("_bucket", F.floor(F.unix_timestamp("_at") / bucket_seconds))
    inside = W.partitionBy(key, "_bucket").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = both.withColumn("_m", F.max("_f").over(inside)).where("_kind = 1")
    ends = both.groupBy(key, "_bucket").agg(F.max("_f").alias("_e"))
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(key, "_bucket", F.max("_e").over(before).alias("_c"))
    best = F.greatest(F.col("_m"), F.col("_c"))
    found = local.join(carry, [key, "_bucket"]).withColumn("_best", best).where("_best is not null")
    out = found.select(key, "_l.*", *[F.col(f"_best._v.{c}").alias(c) for c in fields])
    if max_age_seconds is not None:
        out = out.where(F.unix_micros(label_ts) - F.unix_micros(feature_ts) <= F.lit(int(max_age_seconds * 1_000_000)))
    return out


def carry_forward(df: DataFrame, keys: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """The last non-null value of ``column`` up to each row."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(out, F.last(column, True).over(w))


def next_start(df: DataFrame, keys: list[str], order: str, out: str = "end") -> DataFrame:
    """The row after each row starts here: its order value minus one ends this row; null for the last."""
    return df.withColumn(out, F.lead(order).over(W.partitionBy(*keys).orderBy(order)) - 1)


def bounded_history(df: DataFrame, keys: list[str], order: list[str], column: str, size: int, out: str, current: bool = False) -> DataFrame:
    """The last ``size`` values before each row, or up to and with it."""
    frame = (-(size - 1), 0) if current else (-size, -1)
    return df.withColumn(out, F.collect_list(column).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)))


def lookback(df: DataFrame, keys: list[str], seconds_column: str, seconds: int, aggregate: Column, out: str) -> DataFrame:
    """An aggregate over the rows of the last ``seconds``, this one included."""
    return df.withColumn(out, aggregate.over(W.partitionBy(*keys).orderBy(seconds_column).rangeBetween(-seconds, 0)))


def snapshot_counts(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str) -> DataFrame:
    """A running count that is refreshed at the first row of each bucket, that row included, and stale until the next."""
    run = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumn("_run", F.count("*").over(run)).withColumn("_bucket", bucket)
    return df.withColumn(out, F.min("_run").over(W.partitionBy(*keys, "_bucket"))).drop("_run", "_bucket")


def islands(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: first and last of each."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(number))
    return (
        df.select(*keys, number).distinct().withColumn("_g", F.col(number) - rn).groupBy(*keys, "_g").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_g")
    )


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column, out: str = "rank") -> DataFrame:
    """The first k rows of each key in a total order."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)


def groups_of(df: DataFrame, keys: list[str], order: list[str], size: int, out: str = "group") -> DataFrame:
    """Rows numbered in groups of ``size``, from 0."""
    return df.withColumn(out, F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("long"))


def interval_join(requests: DataFrame, feedback: DataFrame, keys: list[str], request_ts: str, feedback_ts: str, wait_seconds: int) -> DataFrame:
    """Each request with the feedback of its keys that came within the wait; time buckets make it an equi-join."""
    a = requests.withColumn("_b", F.floor(F.unix_timestamp(request_ts) / wait_seconds))
    a = a.withColumn("_b", F.explode(F.array("_b", F.col("_b") + 1)))
    b = feedback.withColumn("_b", F.floor(F.unix_timestamp(feedback_ts) / wait_seconds))
    late = F.unix_micros(feedback_ts) - F.unix_micros(request_ts)
    return a.join(b, [*keys, "_b"]).where((late >= 0) & (late <= wait_seconds * 1_000_000)).drop("_b")
