"""Stop and retry: a batch that fails is given again with its number, and stateful streams go on where they stopped."""

import os

import pytest
from pyspark.sql import functions as F

from larkspan.operators import graph
from larkspan.streaming import stateful

from .test_operators import events, finish, rows


def test_failed_batch_is_tried_again(spark, tmp_path):
    """The second batch fails after it was written; the restarted query gives it again under the same number."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    ev = events(spark)
    ev.repartitionByRange(3, "ts").write.parquet(source)
    tried = []

    def merge(batch, number):
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")  # by number: twice is once
        tried.append(number)
        if number == 1 and tried.count(1) == 1:
            raise RuntimeError("sink is down")

    start = lambda: stateful.foreach_batch_merge(stateful.read_events(spark, source, ev.schema), sink, str(tmp_path / "cp"), merge)
    with pytest.raises(Exception, match="sink is down"):
        start().awaitTermination(120)
    assert tried == [0, 1]
    start().awaitTermination(120)
    assert tried == [0, 1, 1, 2]
    assert rows(spark.read.parquet(sink), "event_id", "item") == rows(ev, "event_id", "item")


def append_stream(spark, tmp_path, ev, build, cut):
    """All outputs of a stateful stream that is stopped after the events before ``cut`` and started again."""
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in (ev.where(F.col("event_id") < cut), ev.where(F.col("event_id") >= cut)):
        part.coalesce(1).write.mode("append").parquet(source)
        df = build(stateful.read_events(spark, source, ev.schema))
        save = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last = part.agg(F.max(F.unix_micros("ts"))).first()[0]
        seen = lambda: "as_of" in df.columns and os.path.exists(out) and spark.read.schema(df.schema).parquet(out).agg(F.max("as_of")).first()[0] == last  # noqa: B023, E731
        finish(df.writeStream.outputMode(MODES[build]).foreachBatch(save).option("checkpointLocation", cp).trigger(availableNow=True).start(), seen)
    return spark.read.schema(df.schema).parquet(out)


def edges_of(df):
    return stateful.cooccurrence_edges(df, "user_id", "item", "ts", "event_id", 4)


def recent_of(df):
    return stateful.recent_actions(df, ["user_id"], 3, 36000)


MODES = {edges_of: "append", recent_of: "update"}


def test_edges_survive_a_restart(spark, tmp_path):
    ev = events(spark)
    out = append_stream(spark, tmp_path, ev, edges_of, 31)
    got = rows(out.groupBy("src", "dst").agg(F.countDistinct("event_id").alias("w")), "src", "dst", "w")
    assert got == rows(graph.cooccurrence(ev, "user_id", "item", ["ts", "event_id"], 4), "src", "dst", "weight")


def test_recent_actions_survive_a_restart(spark, tmp_path):
    ev = events(spark)
    out = append_stream(spark, tmp_path, ev, recent_of, 50)
    last = out.groupBy("user_id").agg(F.max_by("items", "as_of").alias("items")).collect()
    assert sorted((r.user_id, r["items"]) for r in last) == [(u, [(i * 7) % 5 for i in range(60) if i % 3 == u][-3:]) for u in range(3)]
