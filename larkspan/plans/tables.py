"""How the given tables are read as the library's data model; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: The fixed "now" of the behaviour queries.
NOW = "2024-01-31 00:00:00"


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    item = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", item.alias("item"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(user, item) with repeats: which customer ordered which part."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item"))
    return o.join(li, "o_orderkey").select("user", "item")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: the source's number is the chapter, the language the section."""
    docs = table(spark, d, "documents")
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    return docs.select(
        F.col("doc_id").alias("id"), F.concat("source", F.lit(".pdf")).alias("source"), F.lit("").alias("title"), F.col("lang").alias("section"), "text",
        n.alias("chapter"), (F.col("doc_id") % 50 + 1).cast("int").alias("page_start"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


EV = """ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item FROM events)"""
AGE = f"(epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 86400.0"
PAIRS = """pr AS (SELECT o_custkey AS "user", l_partkey AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""
CHUNKS = """ch AS (SELECT doc_id AS id, source || '.pdf' AS source, lang AS section, text, CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) AS chapter,
           CAST(doc_id % 50 + 1 AS INT) AS page_start FROM documents)"""


def age_days():
    return (F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_micros("ts") / 1e6) / 86400.0
