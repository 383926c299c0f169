"""Record contracts: point-in-time leakage, serving budget, release agreement, and verdicts over phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PHASES = ("baseline", "fault", "recovery")


def epoch(value: Column) -> Column:
    """Seconds from a number, or from ISO-8601 text with a zone; text without a zone is null."""
    text = value.cast("string")
    number = text.rlike(r"^\s*[-+]?[0-9]+(\.[0-9]+)?\s*$")
    zoned = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    stamp = F.unix_micros(F.try_to_timestamp(text)) / 1e6
    return F.when(number, F.trim(text).try_cast("double")).when(zoned, stamp)


def feature_time_ok() -> Column:
    """A selected feature is not later than its label."""
    return ~(F.col("selected") & (F.col("feature_time") > F.col("label_time")))


def serving_ok() -> Column:
    """Within the budget and with candidates."""
    return (F.col("elapsed_ms") <= F.col("budget_ms")) & (F.col("candidates") > 0)


def releases_ok() -> Column:
    """The three releases agree exactly when the request was accepted.

    In the fault phase a rejected mismatch is right; outside it a rejection is a failure even when releases agree.
    """
    same = F.size(F.array_distinct(F.array("model_release", "embedding_release", "index_release"))) == 1
    return F.when(F.col("phase") == "fault", same == F.col("accepted")).otherwise(same & F.col("accepted"))


def check(records: DataFrame, ok: Column, number: str = "record") -> DataFrame:
    """One row: status, the failed record numbers in order, and which phases have no record."""
    failed = F.array_sort(F.collect_list(F.when(~F.coalesce(ok, F.lit(False)), F.col(number))))
    missing = F.array_except(F.array(*[F.lit(p) for p in PHASES]), F.collect_set("phase"))
    return records.agg(failed.alias("failed"), missing.alias("missing_phases"), F.count("*").alias("records")).select(
        F.when((F.size("failed") == 0) & (F.size("missing_phases") == 0), "passed").otherwise("failed").alias("status"), "*"
    )


def verdict(phases: DataFrame) -> DataFrame:
    """From (phase, ok, command_failed): what three phases show together."""
    def bad(p):
        return F.coalesce(F.max(F.when(F.col("phase") == p, ~F.col("ok"))), F.lit(True))

    return phases.agg(F.max("command_failed").alias("c"), bad("baseline").alias("b"), bad("fault").alias("f"), bad("recovery").alias("r")).select(
        F.when(F.col("c"), "command_failed")
        .when(F.col("b") | F.col("r"), "baseline_or_recovery_failed")
        .when(F.col("f"), "fault_reproduced_and_recovered")
        .otherwise("fault_not_reproduced")
        .alias("verdict")
    )


def reject_leaks(rows: DataFrame, label_ts: str, feature_ts: str) -> DataFrame:
    """The rows unchanged; reading them fails when a feature is later than its label."""
    leak = F.col(feature_ts) > F.col(label_ts)
    guarded = F.when(leak, F.raise_error(F.lit("future feature"))).otherwise(F.col(feature_ts))
    return rows.withColumn(feature_ts, guarded)


def version_gate(requests: DataFrame, model: str, index: str) -> DataFrame:
    """Requests that may be answered: model and index agree, and the request asks for that version."""
    return requests.where(F.lit(model == index) & (F.col("version") == index))


def required_fields(submissions: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, missing): the rules (name, pattern) that a submission's text does not meet; rules are a small table."""
    lacking = submissions.crossJoin(F.broadcast(rules)).where(~F.coalesce(F.expr("text rlike pattern"), F.lit(False)))
    found = lacking.groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("missing"))
    return submissions.select("id").join(found, "id", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))


def constraint_gaps(designs: DataFrame, required: list[str], positive: list[str]) -> DataFrame:
    """Names of required fields that are null and of numbers that are not above zero."""
    gap = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    bad = F.filter(F.array(*[F.when(F.col(c) <= 0, F.lit(c)) for c in positive]), lambda x: x.isNotNull())
    return designs.select("id", gap.alias("missing"), bad.alias("invalid"))


def path_policy(paths: DataFrame, allowed: list[str], denied: list[str]) -> DataFrame:
    """Paths that a deny pattern matches, or that no allow prefix covers."""
    ok = F.lit(False)
    for prefix in allowed:
        ok = ok | F.startswith("path", F.lit(prefix))
    no = F.lit(False)
    for pattern in denied:
        no = no | F.col("path").rlike(pattern)
    return paths.where(no | ~ok)


def valid_slices(slices: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Slices with an author, at most ``minutes`` old, whose vector could be read; one row per slice."""
    age = F.unix_timestamp(now) - F.unix_timestamp("ts")
    return slices.where((F.col("author_id") > 0) & (age <= minutes * 60) & F.col("vec").isNotNull())


def with_identity(log: DataFrame) -> DataFrame:
    """Log rows with a user or a device; ``actor`` is the first there is."""
    return log.withColumn("actor", F.coalesce(F.col("user_id").cast("string"), "device_id")).where("actor is not null")


def review_errors(reviews: DataFrame, fields: list[str], tasks: list[str]) -> DataFrame:
    """Rows with a problem: unknown task or label, a score out of 0..2, a bad time, or a repeated (task, label, reviewer)."""
    again = F.count("*").over(W.partitionBy("task_id", "label", "reviewer")) > 1
    score = F.lit(False)
    for f in fields:
        score = score | F.col(f).isNull() | ~F.col(f).between(0, 2)
    t = F.col("first_success_seconds")
    time = t.isNull() | F.isnan(t) | (t < 0) | (t == float("inf"))
    named = F.array(
        F.when(~F.coalesce(F.col("task_id").isin(tasks), F.lit(False)), "task"),
        F.when(~F.coalesce(F.col("label").isin("A", "B"), F.lit(False)), "label"),
        F.when(score, "score"),
        F.when(time, "time"),
        F.when(again, "duplicate"),
    )
    return reviews.withColumn("errors", F.filter(named, lambda x: x.isNotNull())).where("size(errors) > 0")


def diagnose(submissions: DataFrame, placeholder: str, least_chars: int, answers: int) -> DataFrame:
    """Findings on each text: placeholders left in, too short without white space, fewer numbered answers than asked."""
    bare = F.length(F.regexp_replace("text", r"\s+", ""))
    found = F.size(F.regexp_extract_all("text", F.lit(r"(?m)^\s*[0-9]+[.)]\s*\S"), F.lit(0)))
    named = F.array(
        F.when(F.col("text").rlike(placeholder), "placeholder"), F.when(bare < least_chars, "short"), F.when(found < answers, "answers")
    )
    return submissions.select("id", F.filter(named, lambda x: x.isNotNull()).alias("findings"))


# Words by which a query asks for a printed chapter, words by which it knows better, and the reference.
ASKS_FOR_PRINT = "已发布|正式出版|完整原书|PDF|页码"
KNOWS_BETTER = "尚未|未发布"
CHAPTER = "第([零一二三四五六七八九十0-9]+)章"


def unreleased_references(queries: DataFrame, released: DataFrame) -> DataFrame:
    """(qid, chapter): chapters that are not released although a query asks for them in print.

    Chapters may be named in digits or numerals.  A query that does not ask for print, or that itself says that the
    chapter is not out yet, is about the topic and passes.
    """
    from ..functions.text import chapter_number

    asks = queries.where(F.col("query").rlike(f"(?i){ASKS_FOR_PRINT}") & ~F.col("query").rlike(KNOWS_BETTER))
    named = asks.select("qid", F.explode(F.regexp_extract_all("query", F.lit(CHAPTER), F.lit(1))).alias("raw"))
    numbers = named.select("qid", chapter_number(F.col("raw")).alias("chapter")).where("chapter is not null").distinct()
    return numbers.join(released, "chapter", "left_anti").select("qid", "chapter")
