"""Behaviour features of users: windows, decay, entropy, sessions, freshness, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import running

#: Actions that count as a click: a click itself and a watch.
CLICKS = ("click", "watch")


def window_features(events: DataFrame, user: str, age_days: Column, action: Column, value: Column, windows=(1, 7, 30)) -> DataFrame:
    """Per user: clicks (click or watch) and mean watch value in each window.

    A window has no upper bound: events after "now" have negative age and count.  A window without clicks counts 0.
    """
    aggs = []
    for w in windows:
        inside = age_days <= w
        aggs += [
            F.count_if(inside & action.isin(*CLICKS)).alias(f"click_{w}d"),
            F.coalesce(F.avg(F.when(inside & (action == "watch"), value)), F.lit(0.0)).alias(f"watch_{w}d"),
        ]
    return events.groupBy(user).agg(*aggs)


def decayed_sums(events: DataFrame, user: str, age_days: Column, action: Column, value: Column, rate: float = 0.1) -> DataFrame:
    """Per user: clicks and watch value, each event weighted by exp(-rate * age); events after "now" are left out."""
    weight = F.exp(-rate * age_days)
    return events.where(age_days >= 0).groupBy(user).agg(
        F.sum(F.when(action.isin(*CLICKS), weight).otherwise(0.0)).alias("decayed_clicks"),
        F.sum(F.when(action == "watch", weight * value).otherwise(0.0)).alias("decayed_watch"),
    )


def engagement_labels(features: DataFrame, clicks: str, days: int, recency: str, intensity: str) -> DataFrame:
    """Frequency (over 0.5 clicks a day), recency (under 3 days) and intensity (over 20) as values and labels."""
    return features.select(
        "*",
        (F.col(clicks) / days).alias("frequency"),
        (F.col(clicks) / days > 0.5).alias("frequent"),
        (F.col(recency) < 3).alias("recent"),
        (F.col(intensity) > 20).alias("intense"),
    )


def share_entropy(counts: DataFrame, keys: list[str], category: str, n: str) -> DataFrame:
    """Per key: the largest category (ties: the least), its share, and the Shannon entropy of the shares."""
    total = W.partitionBy(*keys)
    p = F.col(n) / F.sum(n).over(total)
    return counts.withColumn("_p", p).groupBy(*keys).agg(
        F.min_by(category, F.struct(-F.col(n), F.col(category))).alias("top"),
        F.max("_p").alias("top_share"),
        F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.ln("_p")).otherwise(0.0)).alias("entropy"),
    )


def rank_change(scores: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Positions under two scores and how far each key moved up."""
    ranked = scores.select(key, F.col(before).alias("_b"), F.col(after).alias("_a"))
    for score, name in (("_b", "before"), ("_a", "after")):
        ranked = running(ranked, score, {name: F.lit(1)}, [key], descending=True)
    return ranked.select(key, "before", "after", (F.col("before") - F.col("after")).alias("moved"))


def leaderboard_overlap(scores: DataFrame, key: str, a: str, b: str, k: int) -> DataFrame:
    """How many of the first k are the same under two scores."""
    first = scores.orderBy(F.desc(a), key).limit(k).select(key)
    return first.join(scores.orderBy(F.desc(b), key).limit(k).select(key), key).agg(F.count("*").alias("overlap")).withColumn("share", F.col("overlap") / k)


def inventory(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: share of non-null values and number of distinct ones, in one aggregation."""
    aggs = []
    for c in columns:
        aggs += [(F.count(c) / F.count("*")).alias(f"{c}__coverage"), F.countDistinct(c).alias(f"{c}__distinct")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}__coverage").alias("coverage"), F.col(f"{c}__distinct").alias("cardinality")) for c in columns]
    return wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def position_report(df: DataFrame, position: str, value: str) -> DataFrame:
    """Per position: exposures, their share, the mean value and the mean relative to the first position's."""
    by = df.groupBy(position).agg(F.count("*").alias("exposures"), F.avg(value).alias("mean"))
    everything = W.partitionBy(F.lit(1))
    return by.select(
        position,
        "exposures",
        (F.col("exposures") / F.sum("exposures").over(everything)).alias("share"),
        "mean",
        (F.col("mean") / F.min_by("mean", position).over(everything)).alias("relative"),
    )


def decay_rate(by_position: DataFrame, position: str, mean: str) -> DataFrame:
    """Rate of an exponential decay by position: minus the slope of the log mean."""
    return by_position.agg((-F.regr_slope(F.ln(mean), F.col(position).cast("double"))).alias("rate"))


def correlations(df: DataFrame, columns: list[str], least: float) -> DataFrame:
    """Pairs of columns with an absolute Pearson correlation above ``least``, all in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs]
    return wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*").where(F.abs("r") > least)


def head_share(counts: DataFrame, key: str, n: str, share: float = 0.9) -> DataFrame:
    """How few keys, most frequent first, cover ``share`` of the mass.

    Keys of equal count are interchangeable, so the running sum goes over the distinct counts, not the keys.
    """
    by_count = counts.groupBy(n).agg(F.count("*").alias("keys"))
    total = counts.agg(F.sum(n).alias("total"), F.count("*").alias("all_keys"))
    run = running(by_count, n, {"mass": F.col(n) * F.col("keys"), "upto": F.col("keys")}, descending=True).crossJoin(F.broadcast(total))
    goal = F.col("total") * share
    # the first count whose running mass reaches the goal; of its keys, those not needed are given back
    at = run.where(F.col("mass") >= goal).agg(F.max_by(F.struct("mass", "upto", "total", "all_keys", F.col(n).alias("n")), n).alias("x")).select("x.*")
    spare = F.floor((F.col("mass") - F.col("total") * share) / F.col("n"))
    return at.select((F.col("upto") - spare).cast("long").alias("head_keys"), "all_keys")


def bucket_counts(events: DataFrame, keys: list[str], ts: str, dedup: str, delta: str, now: Column, hours=(1, 24, 168)) -> DataFrame:
    """Counters over lookback windows: an event id counts once, id -1 is never a duplicate, older events have expired."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(ts)) / 3600
    once = events.where(F.col(dedup) != -1).groupBy(*keys, dedup).agg(F.min(ts).alias(ts), F.min_by(delta, ts).alias(delta))
    every = events.where(F.col(dedup) == -1).select(*keys, dedup, ts, delta)
    rows = once.select(*keys, dedup, ts, delta).unionByName(every)
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when((age >= 0) & (age <= h), F.col(delta))), F.lit(0)).cast("long").alias(f"count_{h}h") for h in hours])


def smoothed_ctr(shows: Column, clicks: Column, prior: float = 0.02, weight: float = 100.0) -> Column:
    """Click rate drawn towards a prior, which it equals without impressions.  The weight is this library's choice."""
    return (clicks + prior * weight) / (shows + weight)


def freshness_coverage(events: DataFrame, keys: list[str], minute: str, now_minute: int, lags: list[int], window: int = 60) -> DataFrame:
    """For each pipeline lag, the share of the last hour's events that are already visible; the lags are a small list."""
    age = F.lit(now_minute) - F.col(minute)
    inside = (age >= 0) & (age < window)
    rows = [F.struct(F.lit(x).alias("lag"), F.count_if(inside & (age >= x)).alias("visible"), F.count_if(inside).alias("actual")) for x in lags]
    out = events.groupBy(*keys).agg(F.array(*rows).alias("_r")).select(*keys, F.explode("_r").alias("_r")).select(*keys, "_r.*")
    return out.where("actual > 0").withColumn("coverage", F.col("visible") / F.col("actual"))
