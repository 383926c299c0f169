"""What the operators share: the scratch area, word patterns and small column helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffles_removed

#: The characters that separate words, as a Java and RE2 character class.
SPACE = r"\x20\x09-\x0D"
#: A broadcast of ids stays under this many rows (16 bytes each); beyond it the same join is shuffled.
BROADCAST_IDS = 400_000
#: Rows of an Arrow batch.
BATCH_ROWS = 2000
#: A driver's heap that has grown beyond this share of its limit is collected, and so shrunk, after a settled step.
HEAP_SHARE = 0.5


_local: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir; only a local session may go without, and then
    has a temporary folder that goes when the program ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/").rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="larkspan-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores in front until ``df`` has no such column, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small: each is held in the JVM, on its way, and in the worker at the same time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shrink_heap(spark: SparkSession) -> None:
    """Plans, task records and small broadcasts of a step that is over are garbage, but a heap grows to its limit before
    they go; beyond HEAP_SHARE of the limit they go now, and the heap returns what it has over its live objects."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        spark._jvm.System.gc()


def settle(df: DataFrame, name: str, folders: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder, by ``folders`` if given, and read again: lineage ends there and lost executors
    cost nothing.  The shuffle files of the step go with it, and what it left in a large heap of the driver."""
    bound_batches(df.sparkSession)
    path = scratch(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(*(folders or [])).parquet(path)
    shrink_heap(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): ``row`` tells every row from every other.  It is the id where ids are unique and none is null;
    else the rows are settled with a number of their own."""
    slim = docs.select("doc_id", "text")
    n, ids = slim.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        return slim.withColumn("row", F.col("doc_id"))
    return settle(slim.withColumn("row", F.monotonically_increasing_id()), "rows")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in whichever store holds it."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Delete the settled tables that ``df`` reads, once nothing that is still to run reads them."""
    spark = df.sparkSession
    root = scratch_root(spark)
    for name in {f.rsplit("/", 2)[-2] for f in df.inputFiles()}:
        remove(spark, f"{root}/{name}")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` computed once per row, however often ``x`` appears in nested lambdas."""
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def ids_filter(df: DataFrame, ids: DataFrame, key: str, how: str, limit: int | None = None) -> DataFrame:
    """Semi or anti join on distinct ids, broadcast only while their count is within ``limit`` (BROADCAST_IDS), else
    shuffled."""
    if ids.count() <= (BROADCAST_IDS if limit is None else limit):
        return df.join(F.broadcast(ids), key, how)
    return df.join(ids.hint("shuffle_hash"), key, how)
