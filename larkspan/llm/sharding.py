"""Sharding by sampled splitters.

Records are ordered by (content hash, id, a number of the row).  A size-weighted sample of the keys gives quantile boundaries of many
ranges; the exact bytes of every range are then summed, ranges with too many bytes are subdivided by splitters of
their own, and a prefix sum over the ranges and within each range gives each record its exact place.  A shard is an
equal share of all bytes (law ``bytes``): the record goes where its middle byte falls.  Texts are hashed where they
are read; only slim rows are shuffled, and no range, hence no task, holds more than a small share of all bytes, however
many equal texts there are, because the id is part of the key.

Cases: a null text has size 1 and the checksum of the empty string; texts of any length are read whole; equal texts are
neighbours in the order, so they share a shard unless a boundary falls among them; a null id comes before all others;
rows equal in id and text are interchangeable and each gets its own slot; an empty table gives an empty table; fewer
records than shards leave some shards empty; one record larger than a shard's share stays whole; only id and text are
read, so other columns' names may clash (``write_shards`` replaces columns named ``shard`` and ``slot``).
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle

#: Where the order puts rows without an id.
NO_ID = -(1 << 63)
#: Keys sampled for splitters, in expectation; the driver holds that many.
SAMPLE = 20_000
#: Ranges a shard is cut into; a range above TOO_FULL times the mean range is subdivided.
RANGES_PER_SHARD = 16
TOO_FULL = 2.0


def slim_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("row"),
    )


def _splitters(rows: DataFrame, ranges: int, sample: int) -> list[tuple[int, int, int]]:
    """Quantile boundaries of the byte mass: a key enters the sample with probability size * rate."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total or ranges < 2:
        return []
    rate = sample / total
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "h", "row", F.lit(17)), 11) / F.lit(float(1 << 53))
    weight = F.greatest(F.lit(1.0), F.col("size") * rate)  # a record above 1/sample of all bytes is always drawn
    drawn = rows.where(u < F.col("size") * rate).select("h", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "row", weight.alias("w")).collect()
    drawn = sorted((r.h, r.d, r.row, r.w) for r in drawn)
    if not drawn:
        return []
    cum = np.cumsum([x[-1] for x in drawn])
    at = np.searchsorted(cum, np.arange(1, ranges) * cum[-1] / ranges, "left")
    return sorted({drawn[min(i, len(drawn) - 1)][:3] for i in at})


def _range_of(rows: DataFrame, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """Number of splitters that are below the key or equal to it, by binary search in Arrow batches."""
    hs = np.array([c[0] for c in cuts], dtype=np.int64)

    def assign(batches):
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False)
            d = b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            r = b.column("row").to_numpy(zero_copy_only=False)
            lo, hi = np.searchsorted(hs, h, "left"), np.searchsorted(hs, h, "right")
            out = lo.copy()
            for i in np.flatnonzero(hi > lo):  # the hash is a splitter's own: id and row decide
                out[i] = bisect.bisect_right(cuts, (h[i], d[i], r[i]), lo[i], hi[i])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out.astype(np.int32))], [*b.schema.names, "r"])

    return rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("r", T.IntegerType())]))


def place(rows: DataFrame, shards: int = 8, sample: int = SAMPLE, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """Rows (doc_id, size, h, row, ...) with shard and slot; ``size`` must be positive, ``row`` settled."""
    spark = rows.sparkSession
    ranges = shards * ranges_per_shard
    cuts = _splitters(rows, ranges, sample)
    for _ in range(3):
        ranged = settle(_range_of(rows, cuts), "ranges")
        sums = ranged.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("r").collect()
        total = sum(x.b for x in sums)
        limit = TOO_FULL * total / ranges
        full = [x.r for x in sums if x.b > limit and x.n > 1]
        finer = []
        if full:
            inside = ranged.where(F.col("r").isin(full)).drop("r")
            finer = _splitters(inside, 4 * len(full), sample)
        if not set(finer) - set(cuts):
            break
        cuts = sorted({*cuts, *finer})
    bytes_before, at_b, at_n = [], 0, 0
    for x in sums:
        bytes_before.append((x.r, at_b, at_n))
        at_b, at_n = at_b + x.b, at_n + x.n
    offsets = spark.createDataFrame(bytes_before, "r int, b0 long, n0 long")
    order = W.partitionBy("r").orderBy("h", "doc_id", "row")
    cum = ranged.select(
        "*",
        F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_cb"),
        F.row_number().over(order).alias("_rn"),
    ).join(F.broadcast(offsets), "r")
    middle = F.col("b0") + F.col("_cb") - F.col("size") / 2
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(total, 1)))).cast("int"))
    placed = settle(cum.select("*", shard.alias("shard"), (F.col("n0") + F.col("_rn") - 1).alias("_at")), "placed")
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    out = placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_at") - F.col("_first"))
    return out.drop("r", "b0", "n0", "_cb", "_rn", "_at", "_first")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    rows = settle(slim_rows(docs, id_col, text_col), "sizes")
    return place(rows, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents themselves as Parquet, one folder per shard, in slot order within each file; equal rows share a slot,
    columns of the documents named ``shard`` and ``slot`` are replaced."""
    rows = settle(slim_rows(docs, id_col, text_col), "sizes")
    places = place(rows, shards).groupBy("doc_id", "h").agg(F.min("shard").alias("shard"), F.min("slot").alias("slot"))
    places = places.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    base = docs.drop("shard", "slot")
    full = base.join(places, base[id_col].eqNullSafe(places["_id"]) & (F.xxhash64(F.coalesce(base[text_col], F.lit(""))) == places["_h"]))
    full = full.drop("_id", "_h").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    full.write.partitionBy("shard").parquet(path)
