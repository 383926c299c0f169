"""Views over an append-only log of learning events; ``seq`` is the order of the log, and the last line wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import frontier
from .temporal import first_by, latest_by


def completed(log: DataFrame) -> DataFrame:
    """Distinct keys with a completed record: the concept, else the topic."""
    key = F.coalesce("concept_id", "topic")
    return log.where("status = 'completed'").select(key.alias("id")).where("id is not null").distinct()


def recommended_next(log: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """Nodes whose prerequisites are met, weakest last score first (no score counts 1), then by name."""
    scores = latest_by(log.where("concept_id is not null and score is not null").select("concept_id", "score", "seq"), ["concept_id"], F.col("seq"))
    ready = frontier(nodes, edges, completed(log)).join(scores.select(F.col("concept_id").alias("id"), "score"), "id", "left")
    return ready.select("id", F.coalesce("score", F.lit(1.0)).alias("score")).orderBy("score", "id").limit(limit)


def due_reviews(log: DataFrame, as_of: Column) -> DataFrame:
    """First completed record of each key whose review is due and not resolved by a later review record."""
    due = first_by(log.where("status = 'completed' and review_due is not null").select("concept_id", "review_due", "seq"), ["concept_id"], F.col("seq"))
    last = latest_by(log.where("action = 'review'").select("concept_id", "status", "seq"), ["concept_id"], F.col("seq"))
    resolved = last.where("status = 'passed'").select("concept_id")
    return due.where(F.to_date("review_due") <= as_of).join(resolved, "concept_id", "left_anti").select("concept_id", "review_due")


def overview(log: DataFrame, units: DataFrame) -> DataFrame:
    """Per course: units, completed units and the last activity's sequence number."""
    done = log.where("status = 'completed'").select("course_id", "unit_id").distinct().withColumn("done", F.lit(1))
    last = log.groupBy("course_id").agg(F.max("seq").alias("last_seq"))
    per = units.join(done, ["course_id", "unit_id"], "left").groupBy("course_id").agg(F.count("*").alias("units"), F.count("done").alias("completed"))
    return per.join(last, "course_id", "left")


def current_unit(log: DataFrame, units: DataFrame) -> DataFrame:
    """First unit of each course, in course order, that is not completed."""
    done = log.where("status = 'completed'").select("course_id", "unit_id").distinct()
    return first_by(units.join(done, ["course_id", "unit_id"], "left_anti"), ["course_id"], F.col("ord"))


def self_evaluation(log: DataFrame) -> DataFrame:
    """Assessed and completed records, distinct completions, pass rate and mean score."""
    return log.agg(
        F.count("*").alias("records"),
        F.count_if(F.col("status") == "completed").alias("completed_records"),
        F.countDistinct(F.when(F.col("status") == "completed", F.coalesce("concept_id", "topic"))).alias("completed_keys"),
        F.avg("score").alias("mean_score"),
    )


def checkpoints(units: DataFrame, size: int = 5) -> DataFrame:
    """A unit's concepts in groups of ``size``: (unit_id, checkpoint, concepts)."""
    rows = units.select("unit_id", F.posexplode("concepts").alias("pos", "concept"))
    g = F.floor(F.col("pos") / size)
    listed = rows.groupBy("unit_id", g.cast("int").alias("g")).agg(F.array_sort(F.collect_list(F.struct("pos", "concept"))).alias("c"))
    return listed.select("unit_id", F.concat("unit_id", F.lit("-"), (F.col("g") + 1).cast("string")).alias("checkpoint"), F.transform("c", lambda x: x["concept"]).alias("concepts"))


def review_summary(reviews: DataFrame, assignment: DataFrame, fields: list[str]) -> DataFrame:
    """Per task and system: reviewers, agreement of the first two within one, open conflicts, medians.

    A conflict (first two more than one apart) is settled only by exactly one later review that names both reviewers,
    gives a reason and a score equal to its own; the settled score replaces the field in every reviewer's total.
    """
    by = W.partitionBy("task_id", "label").orderBy("seq")
    r = reviews.withColumn("_n", F.row_number().over(by))
    whole = W.partitionBy("task_id", "label")
    names = F.array_sort(F.collect_set(F.when(F.col("_n") <= 2, F.col("reviewer"))).over(whole))
    r = r.withColumn("_pair", names)
    total = F.lit(0)
    agree, open_ = F.lit(0), F.array().cast("array<string>")
    for f in fields:
        pair = F.collect_list(F.when(F.col("_n") <= 2, F.col(f))).over(whole)
        apart = F.abs(F.get(pair, F.lit(0)) - F.get(pair, F.lit(1)))
        d = F.try_element_at("adjudications", F.lit(f))
        good = (F.col("_n") > 2) & (F.size(d["reviewers"]) == 2) & (F.array_sort(d["reviewers"]) == F.col("_pair"))
        good = good & d["score"].between(0, 2) & (d["score"] == F.col(f)) & (F.trim(d["reason"]) != "")
        votes = F.collect_list(F.when(F.coalesce(good, F.lit(False)), d["score"])).over(whole)
        r = r.withColumns({f"_a_{f}": apart, f"_v_{f}": votes})
        settled = (F.col(f"_a_{f}") > 1) & (F.size(f"_v_{f}") == 1)
        total = total + F.when(settled, F.get(f"_v_{f}", F.lit(0))).otherwise(F.col(f))
        agree = agree + F.when(F.col(f"_a_{f}") <= 1, 1).otherwise(0)
        open_ = F.concat(open_, F.when((F.col(f"_a_{f}") > 1) & ~settled, F.array(F.lit(f))).otherwise(F.array().cast("array<string>")))
    r = r.select("task_id", "label", "reviewer", "first_success_seconds", total.alias("_t"), agree.alias("_g"), open_.alias("_o"))
    out = r.groupBy("task_id", "label").agg(
        F.countDistinct("reviewer").alias("reviewers"),
        F.median("_t").alias("median_score"),
        F.median("first_success_seconds").alias("median_seconds"),
        F.max("_g").alias("agreements"),
        F.first("_o").alias("open_conflicts"),
    )
    return out.join(F.broadcast(assignment), ["task_id", "label"])
