"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. language ID: documents that no learned language fits leave (``larkspan.llm.langid``);
2. exact dedup: of equal texts the smallest id stays (``larkspan.llm.exact``);
3. n-gram Jaccard join: one document of each group of near duplicates stays (``larkspan.llm.jaccard``);
4. mixing: the documents as often as their source's target weight takes them (``larkspan.llm.mixing``);
5. best-fit packing: the pieces of the mixed documents with their place in a sequence (``larkspan.llm.packing``).

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm import exact, jaccard, langid, mixing, packing
from larkspan.llm.common import scratch

#: The language model and the pseudorandom permutations have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_first(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
