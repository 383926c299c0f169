"""Offline and online metrics from their published definitions: classification, ranking, calibration, experiments,
drift, diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import running


def classification(df: DataFrame, y: str, score: str, threshold: float) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 at a threshold."""
    pos, pred = F.col(y) == 1, F.col(score) >= threshold
    c = df.agg(
        F.count_if(pos & pred).alias("tp"), F.count_if(~pos & pred).alias("fp"), F.count_if(pos & ~pred).alias("fn"), F.count_if(~pos & ~pred).alias("tn")
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "*",
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def auc(df: DataFrame, y: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at their mean rank; per key if there are keys.

    Rows meet per distinct score first, so only distinct scores are ordered; without keys they are ordered by ranges.
    """
    by = df.groupBy(*(keys or []), score).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    if keys:
        w = W.partitionBy(*keys).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
        part = by.withColumn("_below", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    else:
        keys = []
        part = running(by.where(F.col(score).isNotNull()), score, {"_upto": F.col("_n")}).withColumn("_below", F.col("_upto") - F.col("_n"))
    agg = part.groupBy(*keys).agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_s"), F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"))
    return agg.select(*keys, "positives", "negatives", F.try_divide(F.col("_s"), F.col("positives") * F.col("negatives")).alias("auc"))


def gauc(df: DataFrame, y: str, score: str, user: str) -> DataFrame:
    """Mean AUC of users weighted by impressions; users with one class only are left out."""
    a = auc(df, y, score, [user]).where("auc is not null").withColumn("w", F.col("positives") + F.col("negatives"))
    return a.agg(F.try_divide(F.sum(F.col("auc") * F.col("w")), F.sum("w")).alias("gauc"), F.count("*").alias("users"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """PCOC and the expected and the largest calibration error over equal-width bins."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins))
    per = df.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"), F.sum(p).alias("sp"), F.sum(y).alias("sy"))
    gap = F.abs(F.col("mp") - F.col("my"))
    return per.agg(
        F.try_divide(F.sum("sp"), F.sum("sy")).alias("pcoc"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce")
    )


def ranking(df: DataFrame, query: str, rel: str, score: str, item: str, k: int) -> DataFrame:
    """Per query NDCG, average precision, reciprocal rank, hit and recall at k."""
    order = W.partitionBy(query).orderBy(F.desc(score), item)
    ideal = W.partitionBy(query).orderBy(F.desc(rel), item)
    every = W.partitionBy(query)
    r = df.select(query, F.col(rel).cast("double").alias("_g"), F.row_number().over(order).alias("_r"), F.row_number().over(ideal).alias("_i"))
    hit = (F.col("_g") > 0).cast("double")
    r = r.withColumn("_hits", F.sum(hit).over(every.orderBy("_r"))).withColumn("_all", F.sum(hit).over(every))
    top, first = F.col("_r") <= k, F.when(hit > 0, F.col("_r"))
    return r.groupBy(query).agg(
        F.coalesce(
            F.try_divide(
                F.sum(F.when(top, (F.pow(F.lit(2.0), "_g") - 1) / F.log2(F.col("_r") + 1.0))), F.sum(F.when(F.col("_i") <= k, (F.pow(F.lit(2.0), "_g") - 1) / F.log2(F.col("_i") + 1.0)))
            ),
            F.lit(0.0),
        ).alias("ndcg"),
        F.coalesce(F.try_divide(F.sum(F.when(top, hit * F.col("_hits") / F.col("_r"))), F.least(F.max("_all"), F.lit(float(k)))), F.lit(0.0)).alias("ap"),
        F.coalesce(1.0 / F.min(F.when(top, first)), F.lit(0.0)).alias("rr"),
        F.coalesce(F.max(F.when(top, hit)), F.lit(0.0)).alias("hit"),
        F.coalesce(F.try_divide(F.sum(F.when(top, hit)), F.max("_all")), F.lit(0.0)).alias("recall"),
    )


def normalise_scores(df: DataFrame, keys: list[str], score: str, out: str = "normalised") -> DataFrame:
    """Min-max within the key; a constant group is 0.5."""
    w = W.partitionBy(*keys or [F.lit(1)])
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(0.5))


def psi(expected: DataFrame, actual: DataFrame, bucket: str, floor: float = 1e-6) -> DataFrame:
    """Population stability index and Kullback-Leibler divergence over common buckets."""
    def share(df, name):
        return df.groupBy(bucket).agg(F.count("*").alias("_n")).select(bucket, (F.col("_n") / F.sum("_n").over(W.partitionBy(F.lit(1)))).alias(name))

    j = share(expected, "e").join(share(actual, "a"), bucket, "full_outer")
    e, a = F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(floor)), F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(floor))
    return j.agg(F.sum((a - e) * F.ln(a / e)).alias("psi"), F.sum(a * F.ln(a / e)).alias("kl"))


def split_traffic(users: Column, layer: str, buckets: int) -> Column:
    """Bucket of a user in a layer; layers are independent of each other."""
    return F.pmod(F.xxhash64(F.lit(layer), users), F.lit(buckets)).cast("int")


def sample_ratio(counts: DataFrame, arm: str, n: str, expected: str) -> DataFrame:
    """Chi-square statistic of observed against expected shares."""
    every = W.partitionBy(F.lit(1))
    e = F.sum(n).over(every) * F.col(expected) / F.sum(expected).over(every)
    return counts.withColumn("_e", e).agg(F.sum(F.pow(F.col(n) - F.col("_e"), 2) / F.col("_e")).alias("chi2"), (F.count("*") - 1).alias("df"))


def welch(df: DataFrame, arm: str, value: str, control, treatment) -> DataFrame:
    """Difference of means, Welch's t and its degrees of freedom."""
    def of(name, f):
        return f(F.when(F.col(arm) == name, F.col(value)))

    s = df.agg(*[of(n, f).alias(f"{x}{y}") for n, x in ((control, "c"), (treatment, "t")) for f, y in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))])
    vc, vt = F.col("cv") / F.col("cn"), F.col("tv") / F.col("tn")
    return s.select(
        (F.col("tm") - F.col("cm")).alias("diff"),
        F.try_divide(F.col("tm") - F.col("cm"), F.sqrt(vc + vt)).alias("t"),
        F.try_divide(F.pow(vc + vt, 2), F.pow(vc, 2) / (F.col("cn") - 1) + F.pow(vt, 2) / (F.col("tn") - 1)).alias("df"),
    )


def two_proportions(df: DataFrame, arm: str, success: Column, control, treatment) -> DataFrame:
    """Rates of two arms and the pooled z statistic."""
    s = df.agg(*[f.alias(n) for n, f in {
        "n1": F.count_if(F.col(arm) == control), "n2": F.count_if(F.col(arm) == treatment),
        "x1": F.count_if((F.col(arm) == control) & success), "x2": F.count_if((F.col(arm) == treatment) & success),
    }.items()])
    pool = (F.col("x1") + F.col("x2")) / (F.col("n1") + F.col("n2"))
    p1, p2 = F.col("x1") / F.col("n1"), F.col("x2") / F.col("n2")
    return s.select(p1.alias("control"), p2.alias("treatment"), F.try_divide(p2 - p1, F.sqrt(pool * (1 - pool) * (1 / F.col("n1") + 1 / F.col("n2")))).alias("z"))


def concentration(counts: DataFrame, n: str) -> DataFrame:
    """Gini coefficient, entropy and Herfindahl index of how mass is spread over keys; keys of equal mass meet first."""
    by = counts.groupBy(n).agg(F.count("*").alias("k"))
    total = counts.agg(F.count("*").alias("keys"), F.sum(n).alias("mass"))
    d = running(by, n, {"upto": F.col("k")}).withColumn("before", F.col("upto") - F.col("k")).crossJoin(F.broadcast(total))
    # ranks before+1 .. before+k share one value: their sum is k * before + k (k + 1) / 2
    ranks = F.col("k") * F.col("before") + F.col("k") * (F.col("k") + 1) / 2
    p = F.col(n) / F.col("mass")
    return d.agg(
        (2 * F.sum(ranks * F.col(n)) / F.max(F.col("keys") * F.col("mass")) - F.max((F.col("keys") + 1) / F.col("keys"))).alias("gini"),
        F.sum(-F.col("k") * p * F.ln(p)).alias("entropy"),
        F.sum(F.col("k") * p * p).alias("hhi"),
    )


def mmr(relevance: np.ndarray, similarity: np.ndarray, k: int, lam: float) -> list[int]:
    """Maximal marginal relevance, greedily; ties go to the lower index."""
    chosen: list[int] = []
    while len(chosen) < min(k, len(relevance)):
        penalty = similarity[:, chosen].max(axis=1) if chosen else np.zeros(len(relevance))
        gain = lam * relevance - (1 - lam) * penalty
        gain[chosen] = -np.inf
        chosen.append(int(np.argmax(gain)))
    return chosen


def diversify(df: DataFrame, query: str, item: str, score: str, vec: str, k: int, lam: float = 0.7) -> DataFrame:
    """MMR within each query by cosine of the vectors: (query, item, rank).  A query's candidates are one group, so
    cut them to a candidate list first."""
    q_type, i_type = df.schema[query].dataType.simpleString(), df.schema[item].dataType.simpleString()

    def work(pdf):
        pdf = pdf.sort_values([score, item], ascending=[False, True], kind="stable").reset_index(drop=True)
        v = np.stack(pdf[vec].to_numpy()).astype(np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        at = mmr(pdf[score].to_numpy(dtype=np.float64), v @ v.T, k, lam)
        return pd.DataFrame({query: pdf[query].iloc[at].to_numpy(), item: pdf[item].iloc[at].to_numpy(), "rank": range(1, len(at) + 1)})

    return df.select(query, item, score, vec).groupBy(query).applyInPandas(work, f"{query} {q_type}, {item} {i_type}, rank int")


def robust_z(df: DataFrame, keys: list[str], value: str, out: str = "robust_z") -> DataFrame:
    """Deviation from the key's median in scaled median absolute deviations; null where that is zero."""
    mid = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    dev = df.join(mid, keys).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    mad = dev.groupBy(*keys).agg(F.median("_d").alias("_mad"))
    return dev.join(mad, keys).withColumn(out, F.try_divide(F.col(value) - F.col("_m"), 1.4826 * F.col("_mad"))).drop("_m", "_d", "_mad")


def period_change(df: DataFrame, keys: list[str], order: str, value: str, lag: int, out: str = "change") -> DataFrame:
    """Relative change against ``lag`` periods before."""
    before = F.lag(value, lag).over(W.partitionBy(*keys).orderBy(order)) if keys else F.lag(value, lag).over(W.orderBy(order))
    return df.withColumn(out, F.try_divide(F.col(value) - before, before))
