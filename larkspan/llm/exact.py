"""Exact deduplication against a persistent digest index.

The index is a table bucketed by digest and sorted by digest within each bucket.  A batch is pre-aggregated to one
row per digest, sort-merge anti-joined with the index, and the digests the index lacks are appended.  Everything is
DataFrame code; the texts are read once and never shuffled, only 32-byte digests are.

Cases: a null text counts as empty and equals other empty or blank ones; texts are equal when identical after each
run of ``[\\x20\\x09-\\x0D]`` becomes one space, and are read whole; of equal texts the smallest id stays, so a row with a
null id stays only where no equal text has an id; a digest that is in the index already keeps the id found there; rows
with the same id and text are both returned, and both marked as kept if that id stays; an empty batch appends nothing;
only id and text are read, so other columns' names may clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, free_names, ids_filter, remove, scratch, settle, shuffle_parts

#: A digest with more than this share of the rows is joined by broadcast; at most 1 / share digests can be.
HOT_SHARE = 0.001


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


class DigestIndex:
    """Persistent (digest, keep_id) table, bucketed and sorted by digest.

    ``path`` is where the files live, in a store that driver and executors share; opening an index at a path that holds
    one registers it again in the session's catalogue.  Without a path the index is a passing one in the shared folder,
    and its files go with ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark, self.passing = spark, path is None
        self.path = path or scratch(spark, "digest-index")
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or shuffle_parts(spark)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` (digest, doc_id) that the index lacks, each with its smallest id."""
        new = batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        fresh = new.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        # the anti-join's output is partitioned by digest already, in as many parts as there are buckets
        (
            settle(fresh.select("digest", "keep_id"), "fresh")
            .repartition(self.buckets, "digest")
            .write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").saveAsTable(self.name)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.passing:
            remove(self.spark, self.path)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest"))


def dedup_batch(slim: DataFrame, index: DigestIndex) -> DataFrame:
    """Add a batch of (doc_id, digest) to the index and mark its rows: keep_id, group_size in the batch, kept."""
    index.add(slim)
    groups = slim.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = settle(groups.join(index.read().hint("merge"), "digest"), "groups")
    return mark(slim, groups)


def mark(slim: DataFrame, groups: DataFrame) -> DataFrame:
    """Join each row to its group (digest, group_size, keep_id); hot groups, few by definition, by broadcast."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") > max(1, int(total * HOT_SHARE))
    few = groups.where(hot).select("digest", F.struct("group_size", "keep_id").alias("_hot"))
    tagged = slim.join(F.broadcast(few), "digest", "left")
    columns = ("doc_id", "digest", "group_size", "keep_id")
    big = tagged.where(F.col("_hot").isNotNull()).select("doc_id", "digest", "_hot.group_size", "_hot.keep_id")
    rest = tagged.where(F.col("_hot").isNull()).drop("_hot").join(groups.where(~hot), "digest").select(*columns)
    return big.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size (over all batches), kept, digest.

    The documents enter a new index in ``batches`` batches of ascending id, so the smallest id of equal texts is the
    first to arrive.
    """
    spark = docs.sparkSession
    slim = settle(digests(docs, id_col, text_col), "digests")
    cuts = slim.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5]).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts)) if batches > 1 else []
    index = DigestIndex(spark)
    # rows without an id come last: an equal text with an id is in the index before them
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.lit(0))
    for c in cuts:
        part = part + F.coalesce(F.col("doc_id") > F.lit(c), F.lit(False)).cast("int")
    try:
        for b in range(len(cuts) + 1):
            index.add(slim.where(part == b))
        sizes = slim.groupBy("digest").agg(F.count("*").alias("group_size"))
        groups = settle(sizes.join(index.read().hint("merge"), "digest"), "groups")
    finally:
        index.drop()
    return mark(slim, groups)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: one that has the group's smallest id.

    Where rows repeat that id, or the group has no id, the row that is first by its columns' hash stays.  All columns
    stay as they are, whatever their names.
    """
    marked = exact_dedup(docs, id_col, text_col)
    # ids that leave with one text and stay with another, and those that stay more than once, are told apart by digest
    mixed = marked.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    gone = settle(marked.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "gone")
    mixed = settle(mixed.select("doc_id"), "mixed")
    (own,) = free_names(docs, "doc_id_")
    if mixed.isEmpty():
        return ids_filter(docs.withColumn(own, F.col(id_col)), gone.withColumnRenamed("doc_id", own), own, "left_anti").drop(own)
    name, one = free_names(docs, "_digest", "_one")
    several = mixed.where("doc_id is not null").withColumnRenamed("doc_id", own)
    tagged = docs.withColumn(own, F.col(id_col))
    single = ids_filter(tagged.where(F.col(own).isNotNull()), several, own, "left_anti")
    single = ids_filter(single, gone.withColumnRenamed("doc_id", own), own, "left_anti").drop(own)
    rest = tagged.where(F.col(own).isNull()).unionByName(ids_filter(tagged, several, own, "left_semi")).drop(own)
    rest = rest.withColumn(name, digest_of(F.col(text_col)))
    stays = settle(marked.where("kept").select(F.col("digest").alias(name), F.col("doc_id").alias(own)).distinct(), "stays")
    order = F.xxhash64(*[x for c in docs.columns for x in (F.col(c), F.col(c).isNull())])
    held = rest.join(stays, name).where(F.col(id_col).eqNullSafe(F.col(own)))
    first = held.groupBy(name).agg(F.min_by(F.struct(*docs.columns), order).alias(one))
    return single.unionByName(first.select(f"{one}.*"))
