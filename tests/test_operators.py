"""Known answers of the operators, and streaming forms against their batch forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions import numbers as N
from larkspan.functions import text as T
from larkspan.functions import vectors as V
from larkspan.operators import behaviour, cf, contracts, funnel, graph, metrics, retrieval, temporal
from larkspan.sources import files
from larkspan.streaming import stateful


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tokens(spark):
    df = spark.createDataFrame([("Été C++ v1.2 协同过滤 x 好",), ("",)], "t string")
    assert [r[0] for r in df.select(T.tokens(F.col("t"))).collect()] == [["t", "c++", "v1.2", "x", "协同", "同过", "过滤", "好"], []]



def test_pack_paragraphs(spark):
    text = "aaa\n\n b  b \n\n\n" + "c" * 8 + "\n\nd"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.pack_paragraphs(F.col("t"), 8)).first()[0] == ["aaa\n\nb b", "c" * 8, "d"]


def test_asof_ties_and_age(spark):
    labels = spark.createDataFrame([("u1", 100, 1), ("u1", 200, 0), ("u2", 5, 1)], "u string, lt long, y int").withColumn("lt", F.timestamp_seconds("lt"))
    feats = spark.createDataFrame([("u1", 80, 0.2, 1), ("u1", 150, 0.8, 3), ("u1", 150, 0.9, 2), ("u1", 220, 1.0, 4)], "u string, ft long, v double, i int").withColumn("ft", F.timestamp_seconds("ft"))
    for bucket in (10, 100, 86400):
        out = temporal.asof_join(labels, feats, "u", "lt", "ft", "i", bucket_seconds=bucket)
        assert rows(out, "u", "v", "y") == [("u1", 0.2, 1), ("u1", 0.9, 0)]
    assert rows(temporal.asof_join(labels, feats, "u", "lt", "ft", "i", max_age_seconds=30), "v") == [(0.2,)]


def test_leak_gate(spark):
    df = spark.createDataFrame([(1, 2)], "label_ts int, feature_ts int")
    with pytest.raises(Exception, match="future feature"):
        contracts.reject_leaks(df, "label_ts", "feature_ts").collect()


def test_item_cf_fixture(spark):
    lists = {"u1": "i1 i2 i3", "u2": "i1 i2 i4", "u3": "i2 i3 i5", "u4": "i1 i3 i5", "u5": "i4 i5"}
    pairs = spark.createDataFrame([(u, i) for u, l in lists.items() for i in l.split()], "user string, item string")
    sim = {(r.item, r.other): r.sim for r in cf.item_similarity(pairs).collect()}
    assert abs(sim["i1", "i2"] - 2 / 3) < 1e-12 and sim["i2", "i1"] == sim["i1", "i2"]
    swing = {(r.item, r.other): r.sim for r in cf.swing_similarity(pairs).collect()}
    assert abs(swing["i1", "i2"] - 1 / 7) < 1e-12 and swing["i4", "i5"] == 0
    twice = pairs.unionByName(spark.createDataFrame([("u5", "i4")], "user string, item string"))
    assert abs({(r.item, r.other): r.sim for r in cf.item_similarity(twice).collect()}["i4", "i5"] - 2 / 3) < 1e-12


def test_merge_and_fallback(spark):
    route = lambda rows_: spark.createDataFrame(rows_, "user string, item string, score double")
    c = funnel.union_routes({"a": route([("u", "same", 0.2), ("u", "tie", 0.5)]), "b": route([("u", "same", 0.9), ("u", "other", 0.6), ("u", "tie", 0.5)])})
    assert {r["item"]: r.route for r in funnel.merge_best(c).collect()} == {"same": "b", "other": "b", "tie": "a"}
    users = spark.createDataFrame([("u", False), ("v", True)], "user string, over boolean")
    out = {r.user: (r["items"], r.degraded, r.reason) for r in funnel.recommend(users, c, ["hot-1", "hot-2"], 1, "over").collect()}
    assert out == {"u": (["same"], False, None), "v": (["hot-1"], True, "overload")}


def test_knn_matches_cosine(spark):
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(40)] + [(99, [0.0] * 8)], "id int, vec array<double>")
    q = items.where("id < 3").select(F.col("id").alias("qid"), "vec")
    slow = q.withColumnRenamed("vec", "qv").crossJoin(items).select("qid", "id", V.cosine(F.col("qv"), F.col("vec")).alias("sim"))
    slow = temporal.top_k(slow, ["qid"], 4, F.desc("sim"), F.col("id"))
    assert rows(retrieval.knn(q, items, 4), "qid", "id", "rank") == rows(slow, "qid", "id", "rank")


def test_vector_expressions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    one = F.array(F.lit(1.0), F.lit(1.0))
    out = df.select(V.dot(a, b), V.relu(b), V.weighted_sum([a, b], [F.lit(2.0), F.lit(1.0)]), V.cross_layer(a, b, one, one), V.softmax(F.array(F.lit(0.0), F.lit(0.0)))).first()
    assert out[0] == 1.0 and out[1] == [3.0, 0.0] and out[2] == [5.0, 3.0] and out[3] == [6.0, 4.0] and out[4] == [0.5, 0.5]


def test_cycles(spark):
    edges = lambda e: spark.createDataFrame(e, "src string, dst string")
    assert graph.on_cycles(edges([("a", "b"), ("b", "c")])).count() == 0
    assert rows(graph.on_cycles(edges([("a", "b"), ("b", "a"), ("b", "c")])), "src", "dst") == [("a", "b"), ("b", "a")]


def test_mmr():
    sim = np.array([[1, 0.95, 0.1], [0.95, 1, 0.1], [0.1, 0.1, 1.0]])
    rel = np.array([0.9, 0.8, 0.5])
    assert metrics.mmr(rel, sim, 2, 1.0) == [0, 1] and metrics.mmr(rel, sim, 2, 0.3) == [0, 2]


def test_apportion_never_exceeds(spark):
    df = spark.createDataFrame([(1, 4, i, w) for i, w in enumerate((97, 1, 1, 1))], "k int, total int, o int, w int")
    assert [r.share for r in N.apportion(df, ["k"], "total", "w", "o").orderBy("o").collect()] == [3, 1, 1, 1]


def test_bucket_counter(spark):
    now = 1_000_000
    df = spark.createDataFrame([(1, now - 10, 9001, 1), (1, now - 5, 9001, 1), (1, now - 3, 9002, 1), (1, now - 200 * 3600, 9003, 1), (1, now, -1, 1), (1, now, -1, 1)], "item int, s long, d long, delta int").withColumn("ts", F.timestamp_seconds("s"))
    out = behaviour.bucket_counts(df, ["item"], "ts", "d", "delta", F.timestamp_seconds(F.lit(now))).first()
    assert (out.count_1h, out.count_168h) == (4, 4)


def test_head_share(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([50, 30, 10, 5, 5])], "k int, n int")
    out = behaviour.head_share(df, "k", "n").first()
    assert (out.head_keys, out.all_keys) == (3, 5)


def test_files(spark, tmp_path):
    p = str(tmp_path / "c.jsonl")
    with open(p, "w") as f:
        f.write('{"id": "a", "text": "x", "chapter": 1}\n\n{"id": "b", "text": "y", "chapter": 2}\n')
    chunks = files.read_chunks(spark, p)
    assert chunks.count() == 2 and chunks.columns[0] == "id"
    prints = files.fingerprints(spark, str(tmp_path), "*.jsonl")
    assert prints.count() == 1
    m = files.write_index(chunks, str(tmp_path / "index"), prints)
    assert m.first().chunks == 2 and len(m.first().index_sha256) == 64
    assert m.first().index_sha256 == files.write_index(chunks.repartition(2), str(tmp_path / "index2"), prints).first().index_sha256
    ev = spark.createDataFrame([("x", 2), ("y", 1)], "action string, ord int")
    files.append_events(ev, str(tmp_path / "log"))
    files.append_events(ev, str(tmp_path / "log"), 2)
    with open(tmp_path / "log" / "part-bad.json", "w") as f:
        f.write("{broken\n")
    good, bad = files.replay(spark, str(tmp_path / "log"), "action string, seq int")
    assert rows(good, "seq", "action") == [(1, "y"), (2, "x"), (3, "y"), (4, "x")] and bad.count() == 1
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, dt string")
    files.overwrite_partitions(df, str(tmp_path / "t"), "dt")
    files.overwrite_partitions(spark.createDataFrame([(9, "a")], "v int, dt string"), str(tmp_path / "t"), "dt")
    assert rows(spark.read.parquet(str(tmp_path / "t")), "v", "dt") == [(2, "b"), (9, "a")]


def test_pages(spark):
    docs = spark.createDataFrame([("d", "# One\ntext\fmore\f# Two\nz")], "id string, text string")
    assert rows(files.pages(docs), "page", "heading") == [(1, "One"), (2, "One"), (3, "Two")]


def stream(spark, tmp_path, df, parts=3):
    path = str(tmp_path / "in")
    df.repartitionByRange(parts, "ts").write.parquet(path)
    return stateful.read_events(spark, path, df.schema)


def finish(q, done=None):
    """Wait for the end; a query with timeouts goes on for their sake, so ``done`` tells when it has done its work."""
    import time

    for _ in range(240):
        if q.awaitTermination(0.1) or (done and done()):
            break
        time.sleep(0.4)
    q.stop()


def run(df, name, mode, done=None):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    finish(q, done and (lambda: done(df.sparkSession.table(name))))
    return df.sparkSession.table(name)


def events(spark):
    base = [(i, i % 3, (i * 7) % 5, 1_700_000_000 + i * 60) for i in range(60)]
    return spark.createDataFrame(base, "event_id long, user_id long, item long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_stream_edges_match_batch(spark, tmp_path):
    ev = events(spark)
    out = run(stateful.cooccurrence_edges(stream(spark, tmp_path, ev, 1), "user_id", "item", "ts", "event_id", 4), "edges", "append")
    got = rows(out.groupBy("src", "dst").agg(F.countDistinct("event_id").alias("w")), "src", "dst", "w")
    assert got == rows(graph.cooccurrence(ev, "user_id", "item", ["ts", "event_id"], 4), "src", "dst", "weight")


def test_stream_windows_match_batch(spark, tmp_path):
    ev = events(spark)
    out = run(stateful.windowed_counts(stream(spark, tmp_path, ev), "ts", ["user_id"], "10 minutes"), "wins", "complete")
    batch = stateful.windowed_counts(ev, "ts", ["user_id"], "10 minutes")
    assert rows(out, "window.start", "user_id", "n") == rows(batch, "window.start", "user_id", "n")


def test_stream_recent_actions(spark, tmp_path):
    ev = events(spark)
    out = run(stateful.recent_actions(stream(spark, tmp_path, ev, 1), ["user_id"], 3, 3600), "recent", "update", lambda t: t.count() == 3)
    assert sorted((r.user_id, r["items"]) for r in out.collect()) == [(u, [(i * 7) % 5 for i in range(60) if i % 3 == u][-3:]) for u in range(3)]


def test_running_order(spark):
    import random

    from larkspan.operators.ordering import running

    rng = random.Random(9)
    rows_ = [(i, float(rng.choice([0, 1, 1, 2, 5, 1e9, -3])) + rng.choice([0, 0, rng.random()])) for i in range(400)]
    df = spark.createDataFrame(rows_, "id int, x double").repartition(5)
    for ranges in (2, 256):
        for down in (False, True):
            out = {r.id: (r.no, r.s) for r in running(df, "x", {"no": F.lit(1), "s": F.col("x")}, ["id"], down, ranges).collect()}
            total = 0.0
            for n, (i, x) in enumerate(sorted(rows_, key=lambda r: (-r[1] if down else r[1], r[0])), 1):
                total += x
                assert out[i][0] == n and abs(out[i][1] - total) < 1e-3
    assert running(df.limit(0), "x", {"no": F.lit(1)}).count() == 0


def test_cycles_need_many_rounds(spark):
    """A long chain loses one edge at each end per round; only the circle at its side stays."""
    chain = [(i, i + 1) for i in range(24)] + [(100, 101), (101, 100), (5, 100)]
    left = graph.on_cycles(spark.createDataFrame(chain, "src int, dst int"))
    assert rows(left, "src", "dst") == [(100, 101), (101, 100)]


def test_scratch_without_settings(tmp_path):
    """A local session without any preset configuration has a scratch folder."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "from pyspark.sql import SparkSession; from larkspan import session as s; spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate();"
        "a, b = s.scratch_path(spark, 'x'), s.scratch_path(spark, 'x'); assert a != b and a.startswith('file:/'); spark.range(3).write.parquet(a); assert spark.read.parquet(a).count() == 3"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": root, "SPARK_CONF_DIR": str(tmp_path)})
