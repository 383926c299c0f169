"""Scans and sinks: JSON lines, pages, sections, front matter, pipe tables, fingerprints, manifests, partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalise

CHUNK = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "source", "locator", "title", "text")]
    + [T.StructField("chapter", T.IntegerType()), T.StructField("section", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("page_start", "page_end")]
    + [T.StructField("kind", T.StringType())]
)


def read_chunks(spark: SparkSession, path: str, schema: T.StructType = CHUNK) -> DataFrame:
    """Typed rows of a JSON-lines file; blank lines are skipped, a line that does not fit the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, size) of files, read by the executors."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def write_index(chunks: DataFrame, path: str, sources: DataFrame, mode: str = "public") -> DataFrame:
    """Write chunks as Parquet partitioned by chapter and return the one-row manifest, written beside them."""
    chunks.write.mode("overwrite").partitionBy("chapter").parquet(f"{path}/chunks")
    # the index digest is a digest of sorted row digests; only digests meet, two to a level
    row = F.sha2(F.to_json(F.struct(*sorted(chunks.columns))), 256)
    parts = chunks.select(row.alias("h")).groupBy(F.substring("h", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    digest = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("index_sha256"))
    listed = sources.agg(F.array_sort(F.collect_list(F.struct("path", "sha256", "size"))).alias("sources"))
    manifest = digest.crossJoin(listed).crossJoin(chunks.agg(F.count("*").alias("chunks"))).select(F.lit(1).alias("format"), F.lit(mode).alias("mode"), "*")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed between two fingerprint tables."""
    p = previous.select("path", F.col("sha256").alias("before"))
    c = current.select("path", F.col("sha256").alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return p.join(c, "path", "full_outer").select("path", kind.alias("change")).where("change is not null")


def append_events(events: DataFrame, path: str, start: int = 0) -> None:
    """Append log rows as JSON lines with a gapless ``seq`` that continues after ``start``; the input has an ``ord`` column."""
    seq = events.withColumn("seq", F.row_number().over(W.orderBy("ord")) + F.lit(start))
    seq.drop("ord").write.mode("append").json(path)


def replay(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt lines) of an event log."""
    both = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    both = both.persist()
    return both.where("_corrupt_record is null").drop("_corrupt_record"), both.where("_corrupt_record is not null").select("_corrupt_record")


def pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per form-feed page, from 1, with the heading in force: a ``# `` line of the page, else the one before."""
    p = docs.select("id", F.posexplode(F.split(text, "\f")).alias("pos", "page_text"))
    head = F.regexp_extract("page_text", r"(?m)^#+ +(.+)$", 1)
    p = p.withColumn("_h", F.when(head != "", head))
    w = W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return p.select("id", (F.col("pos") + 1).alias("page"), normalise(F.col("page_text")).alias("page_text"), F.last("_h", True).over(w).alias("heading"))


def sections(lines: DataFrame, command: str = r"^\\section\{(.*)\}") -> DataFrame:
    """(file, title, first, last) from (file, line_no, line): a section ends before the next begins."""
    marks = lines.select("file", "line_no", F.regexp_extract("line", command, 1).alias("title"), F.col("line").rlike(command).alias("_m")).where("_m")
    ends = lines.groupBy("file").agg(F.max("line_no").alias("_last"))
    nxt = F.lead("line_no").over(W.partitionBy("file").orderBy("line_no")) - 1
    return marks.withColumn("_n", nxt).join(ends, "file").select("file", "title", F.col("line_no").alias("first"), F.coalesce("_n", "_last").alias("last"))


def front_matter(text: Column, key: str) -> Column:
    """Value of ``key: value`` in the block between the first two ``---`` lines."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    found = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(found != "", found)


def markdown_section(text: Column, heading: str) -> Column:
    """Body of a ``## heading`` section up to the next one."""
    body = F.regexp_extract(text, rf"(?ms)^## {heading}[ \t]*\n(.*?)(?=^## |\z)", 1)
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def pipe_rows(lines: DataFrame, line: str = "line", cells: int = 4) -> DataFrame:
    """Rows of a pipe table with the given number of cells and a digit in the second."""
    inner = F.regexp_replace(F.trim(F.col(line)), r"^\||\|$", "")
    c = F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))
    return lines.withColumn("cells", c).where(F.col(line).contains("|") & (F.size("cells") == cells) & F.get("cells", F.lit(1)).rlike("[0-9]"))


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace exactly the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_any(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """Parquet, ORC, CSV, JSON or text by name."""
    return spark.read.options(**options).format(kind).load(path)
