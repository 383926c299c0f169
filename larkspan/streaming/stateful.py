"""Structured Streaming counterparts of the stateful operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files, a bounded number of files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def recent_actions(events: DataFrame, keys: list[str], size: int, ttl_seconds: int, item: str = "item", ts: str = "ts") -> DataFrame:
    """After each batch, per key seen in it: its last ``size`` items within the time to live, oldest first.

    State is at most ``size`` rows per key and leaves when the key has been silent for the time to live.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [*keys]
    types = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in names)
    item_type = events.schema[item].dataType.simpleString()

    def update(key, frames, state):
        held = list(zip(*state.get)) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        for pdf in frames:
            held += list(zip(pdf["_t"].tolist(), pdf[item].tolist()))
        held.sort(key=lambda x: x[0])
        now = held[-1][0]
        held = [x for x in held if x[0] > now - ttl_seconds * 1_000_000][-size:]
        state.update(([x[0] for x in held], [x[1] for x in held]))
        state.setTimeoutDuration(ttl_seconds * 1000)
        yield pd.DataFrame([[*key, [x[1] for x in held], now]], columns=[*names, "items", "as_of"])

    prepared = events.select(*names, F.col(item), F.unix_micros(ts).alias("_t"))
    return prepared.groupBy(*names).applyInPandasWithState(
        update, f"{types}, items array<{item_type}>, as_of long", f"t array<long>, v array<{item_type}>", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def cooccurrence_edges(events: DataFrame, user: str, item: str, ts: str, event: str, window: int = 50) -> DataFrame:
    """Per action, edges both ways between its item and each different item of the user's last ``window`` actions:
    (event, src, dst).  Downstream, edges are idempotent by (src, dst, event)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    item_type = events.schema[item].dataType.simpleString()
    event_type = events.schema[event].dataType.simpleString()

    def update(key, frames, state):
        last = list(state.get[0]) if state.exists else []
        rows = sorted((r for pdf in frames for r in zip(pdf["_t"], pdf[event], pdf[item])), key=lambda r: (r[0], r[1]))
        out = []
        for _, e, i in rows:
            for j in dict.fromkeys(last):
                if j != i:
                    out += [(e, i, j), (e, j, i)]
            last = [*last, i][-window:]
        state.update((last,))
        yield pd.DataFrame(out, columns=[event, "src", "dst"])

    prepared = events.select(user, item, event, F.unix_micros(ts).alias("_t"))
    return prepared.groupBy(user).applyInPandasWithState(
        update, f"{event} {event_type}, src {item_type}, dst {item_type}", f"last array<{item_type}>", "append", GroupStateTimeout.NoTimeout
    )


def edge_weights(edges: DataFrame, ts: str, event: str, late: str = "1 hour") -> DataFrame:
    """Weights of edges that count each event once, within the watermark."""
    once = edges.withWatermark(ts, late).dropDuplicatesWithinWatermark(["src", "dst", event])
    return once.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def last_id_weights(edges: DataFrame, order: str, event: str) -> DataFrame:
    """Weights where an edge only remembers its last event id, so an older id that comes again counts again (batch)."""
    from pyspark.sql import Window as W

    before = F.lag(event).over(W.partitionBy("src", "dst").orderBy(order))
    return edges.withColumn("_new", (before.isNull() | (before != F.col(event))).cast("long")).groupBy("src", "dst").agg(F.sum("_new").alias("weight"))


def windowed_counts(events: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, late: str = "1 hour", dedup: str | None = None) -> DataFrame:
    """Tumbling or sliding counts with a watermark; ``dedup`` drops repeated ids first."""
    df = events.withWatermark(ts, late)
    if dedup:
        df = df.dropDuplicatesWithinWatermark([dedup])
    return df.groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap of silence."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def late_labels(requests: DataFrame, feedback: DataFrame, key: str, request_ts: str, feedback_ts: str, wait: str, late: str = "1 hour") -> DataFrame:
    """Each request with its feedback within the bounded wait, or with nulls once the wait and the watermark are over."""
    a = requests.withWatermark(request_ts, late)
    b = feedback.withColumnRenamed(key, "_key").withWatermark(feedback_ts, late)
    inside = (F.col(feedback_ts) >= F.col(request_ts)) & (F.col(feedback_ts) <= F.col(request_ts) + F.expr(f"interval {wait}"))
    return a.join(b, (F.col(key) == F.col("_key")) & inside, "left_outer").drop("_key")


def merge_labels(rows: DataFrame, keys: list[str], occurred: list[str], accumulated: list[str]) -> DataFrame:
    """Late feedback merged: labels that say whether something happened by maximum, amounts by sum."""
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in occurred], *[F.sum(c).alias(c) for c in accumulated])


def latest_vectors(batch: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Idempotent consumer: each slice once, then the latest vector of each item, merged with those known."""
    rows = batch.dropDuplicates(["slice_id"]).select("item", "slice_id", "ts", "vec")
    rows = rows if known is None else rows.unionByName(known)
    return rows.groupBy("item").agg(F.max_by(F.struct("slice_id", "ts", "vec"), F.struct("ts", "slice_id")).alias("b")).select("item", "b.*")


def changed_counters(before: DataFrame, after: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Counters whose value changed: what an index has to be told."""
    b = before.select(*keys, F.col(n).alias("_b"))
    return after.join(b, keys, "left").where(~F.col(n).eqNullSafe(F.col("_b"))).select(*keys, n)


def inverted_lists(items: DataFrame, k: int | None = None) -> DataFrame:
    """(tag, items): the last version of each item (upsert by ``seq``; ``deleted`` removes), lists by (-score, item)."""
    last = items.groupBy("item").agg(F.max_by(F.struct("score", "tags", "deleted"), "seq").alias("v")).select("item", "v.*").where("not deleted")
    rows = last.select(F.explode("tags").alias("tag"), "item", "score")
    if k is not None:
        from ..operators.temporal import top_k

        rows = top_k(rows, ["tag"], k, F.desc("score"), F.col("item"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "item")))
    return rows.groupBy("tag").agg(F.transform(listed, lambda x: x["item"]).alias("items"))


def foreach_batch_merge(stream: DataFrame, path: str, checkpoint: str, merge):
    """Start a query that gives each batch and its number to ``merge``; a failed batch is tried again with the same
    number, so a merge that is idempotent by number is exactly once."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
