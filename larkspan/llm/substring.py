"""Substring dedup with a log-structured fingerprint index.

Documents arrive in batches of ascending id.  Each batch's window fingerprints become a sorted, immutable run: a table
bucketed and sorted by fingerprint, one row per distinct context with its first document.  A new run is merge-joined,
bucket by bucket without a shuffle, with itself and with the older runs; what shares a fingerprint is verified on a
cryptographic digest of the window's words; older runs are compacted into one when there are more than FAN_OUT.

A window goes if its words also start in a document with a smaller id.  All members of a class (equal gram and equal
context) but those of its first document go whole; for these the digests of the class's windows decide, offset by
offset, against the first document of every other class.

Cases: null and blank texts have no words; a text shorter than a window has none and keeps everything, one of any length
is read whole; windows that repeat within one document only stay; rows that repeat an id are one document, whatever
their texts, and each is cut as itself; rows with a null id lose nothing and are not searched, having no place in the
order; an empty table gives an empty table; columns besides id and text are not read, so their names may clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import identified, remove, scratch, settle, shuffle_parts
from .windows import CLASS, anchor_rows, cut_report, window_digests

WINDOW = 50
#: The query's batches, and the older runs that one is joined with at most: the last one meets a compacted run.
BATCHES = 3
FAN_OUT = 1


class FingerprintIndex:
    """Sorted runs of (fp, c1, c2, n, last, doc_id, row, q, p1, p2); doc_id and the places are those of the context's first
    document, last is its last one.  The runs' files are in the shared folder and go with ``drop``."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_out: int = FAN_OUT):
        self.spark, self.fan_out = spark, fan_out
        self.buckets = buckets or shuffle_parts(spark)
        self.runs: list[str] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, "run")
        writer = rows.repartition(self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp").format("parquet")
        writer.option("path", self.paths[name]).option("compression", "zstd").saveAsTable(name)
        return name

    def _merged(self, rows: DataFrame, n, last) -> DataFrame:
        first = F.min(F.struct("doc_id", "row", "q", "p1", "p2")).alias("f")
        return rows.groupBy(*CLASS).agg(n.alias("n"), last.alias("last"), first).select(*CLASS, "n", "last", "f.*")

    def append(self, anchors: DataFrame) -> DataFrame:
        """Write the batch's run and return it; the older ones are compacted first if they are too many."""
        self.compact()
        name = self._write(self._merged(anchors, F.count("*"), F.max("doc_id")))
        self.runs.append(name)
        return self.spark.table(name)

    def older(self) -> list[DataFrame]:
        return [self.spark.table(r) for r in self.runs[:-1]]

    def compact(self) -> None:
        """Merge all runs into one when there are more than the fan-out; the first document of a context stays."""
        if len(self.runs) <= self.fan_out:
            return
        rows = None
        for r in self.runs:
            t = self.spark.table(r)
            rows = t if rows is None else rows.unionByName(t)
        name = self._write(self._merged(rows, F.sum("n"), F.max("last")))
        self.drop()
        self.runs = [name]

    def drop(self) -> None:
        for r in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")
            remove(self.spark, self.paths.pop(r))
        self.runs = []


def _shared(run: DataFrame, older: list[DataFrame]) -> DataFrame:
    """Fingerprints of the run that stand in two documents, in it or in an older run."""
    own = run.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("last").alias("hi"))
    found = own.where("lo < hi").select("fp")
    for o in older:
        found = found.unionByName(own.select("fp").join(o.select("fp").hint("merge"), "fp", "left_semi"))
    return found.distinct()


def batch_spans(docs: DataFrame, anchors: DataFrame, run: DataFrame, older: list[DataFrame], window: int) -> DataFrame:
    """(row, s, e) to remove from the batch, in words."""
    shared = settle(_shared(run, older), "shared")
    places = run.join(shared.hint("merge"), "fp", "left_semi").withColumn("new", F.lit(True))
    for o in older:
        places = places.unionByName(o.join(shared.hint("merge"), "fp", "left_semi").withColumn("new", F.lit(False)))
    # one class may stand in several runs: the first document counts
    first = F.min(F.struct("doc_id", "row", "q", "p1", "p2")).alias("f")
    classes = places.groupBy(*CLASS).agg(first, F.sum("n").alias("total"), F.max("last").alias("last"), F.max("new").alias("new"))
    classes = settle(classes.select(*CLASS, "f.*", "total", "last", "new"), "classes")
    # only classes that share a fingerprint with another need their windows compared
    several = classes.groupBy("fp").agg(F.count("*").alias("k"), F.max("new").alias("any_new")).where("k > 1 and any_new").select("fp")
    compared = classes.join(several, "fp", "left_semi").withColumn("n", F.col("doc_id"))
    digests = settle(window_digests(docs, compared, window, True), "digests")  # n carries the class's first document
    least = digests.groupBy("d1", "d2").agg(F.min("n").alias("first_doc"), F.max("n").alias("last_doc")).where("first_doc < last_doc")
    later = digests.join(least, ["d1", "d2"]).where(F.col("first_doc") < F.col("n"))
    partly = later.groupBy(*CLASS).agg(F.collect_set("p").alias("gone"))
    verdict = classes.where("new").join(partly, list(CLASS), "left").where((F.col("doc_id") < F.col("last")) | F.col("gone").isNotNull())
    gone = F.transform("gone", lambda p: p - F.col("p1")).alias("gone")  # counted from the context's first window
    verdict = settle(verdict.select(*CLASS, F.col("doc_id").alias("first_doc"), gone), "verdict")
    hit = anchors.join(verdict, list(CLASS))
    whole = hit.where(F.col("doc_id") > F.col("first_doc")).select("row", F.col("p1").alias("s"), (F.col("p2") + window).alias("e"))
    part = hit.where((F.col("doc_id") == F.col("first_doc")) & F.col("gone").isNotNull())
    part = part.select("row", F.explode("gone").alias("w"), "p1").select("row", (F.col("p1") + F.col("w")).alias("s"), (F.col("p1") + F.col("w") + window).alias("e"))
    return whole.unionByName(part)


def repeated_spans(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, fan_out: int = FAN_OUT) -> DataFrame:
    """(row, s, e) for rows (doc_id, text, row): words covered by windows that also start in a document with a smaller id."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null and text is not null")
    index = FingerprintIndex(spark, fan_out=fan_out)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5]).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts)) if batches > 1 else []
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("doc_id") > c).cast("int")
    # a folder for each batch, so that a batch reads its own anchors only
    anchors = settle(anchor_rows(docs, window, True).withColumn("batch", number), "anchors", ["batch"])
    out = None
    try:
        for b in range(len(cuts) + 1):
            batch = anchors.where(F.col("batch") == b).drop("batch")
            run = index.append(batch)
            spans = settle(batch_spans(docs, batch, run, index.older(), window), "spans")
            out = spans if out is None else out.unionByName(spans)
    finally:
        index.drop()
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW, keep_text: bool = False, **options) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, n_spans, kept_sha256 and, if asked for, the kept text."""
    docs = identified(docs)
    spans = repeated_spans(docs, window, **options)
    return cut_report(docs, spans, True, keep_text=keep_text).withColumnRenamed("n_units", "n_words")
