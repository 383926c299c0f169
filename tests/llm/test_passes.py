"""The index of the n-gram join in passes, and shuffle files that go with the step that made them."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from larkspan.llm import common, components, jaccard
from larkspan.llm.common import settle


def _docs(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choice(["kal", "mer", "ton", "sil", "var", "ped", "gro", "lun"]) + str(rng.randrange(9)) for _ in range(60)) for _ in range(8)]
    rows = []
    for i in range(90):
        w = base[i % 8].split()
        w[rng.randrange(60)] = f"x{i % 7}"
        rows.append((i, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_passes_meet_as_one(spark):
    docs = _docs(spark)
    one, four = (jaccard.met_in_passes(docs, np.zeros(0, dtype=np.uint64), 5, 80, 8, n) for n in (1, 4))

    def pairs(met):
        return sorted(tuple(r) for r in met.where("b is not null").groupBy("a", "b").agg(F.sum("c")).collect())

    def large(met):
        return sorted(tuple(r) for r in met.where("b is null").select("key", "a", "na", "rest").collect())

    assert pairs(one) == pairs(four) and large(one) == large(four) and large(one)
    assert jaccard.met_in_passes(docs, np.zeros(0, dtype=np.uint64), 5, 80, 8, 3).count() >= len(large(one))


def test_components_in_passes(spark, monkeypatch):
    docs = _docs(spark)
    want = sorted(tuple(r) for r in jaccard.similar_components(docs).collect())
    monkeypatch.setattr(jaccard, "PASS_TOKENS", 0)
    assert sorted(tuple(r) for r in jaccard.similar_components(docs).collect()) == want


def test_shuffle_files_go_with_the_step(spark):
    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for d in root.localDirsString() for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before = shuffled()
    settle(spark.range(100_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert not shuffled() - before


def test_a_large_heap_is_collected_after_a_step(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()

    def full():
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    steps = []
    for share in (0.0, 1.0):
        monkeypatch.setattr(common, "HEAP_SHARE", share)
        before = full()
        assert settle(spark.range(10), "small").count() == 10
        steps.append(full() - before)
    assert steps[0] >= 1 and steps[1] == 0


def test_few_edges_take_no_rounds(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7)]
    links = spark.createDataFrame(pairs, "a long, b long")
    steps = []
    monkeypatch.setattr(components, "settle", lambda df, name: steps.append(name) or settle(df, name))
    local = sorted(tuple(r) for r in components.components(links).collect())
    assert len(steps) == 1
    monkeypatch.setattr(components, "LOCAL_EDGES", 50)
    assert sorted(tuple(r) for r in components.components(links).collect()) == local and len(steps) > 3
    monkeypatch.setattr(components, "LOCAL_EDGES", 100_000)
    assert components.components(links.limit(0)).count() == 0


def _near_copies(spark, copies=12, texts=40):
    """``copies`` of each text that differ in a word of their own at either end, and pairs across by chance."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(texts)]
    rows = [(1000 * k + i, f"c{k} {x} c{k}" if k else x) for k in range(copies) for i, x in enumerate(bases)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_many_pairs_and_blocks_take_passes(spark, monkeypatch):
    """Beyond what is broadcast neither the texts nor the token sets are shuffled whole or at once."""
    docs = settle(_near_copies(spark).unionByName(_docs(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text")), "docs")
    want = sorted(tuple(r) for r in jaccard.similar_components(docs).collect())
    assert sum(r[0] != r[3] for r in want) >= 11 * 40
    steps, held = [], []
    monkeypatch.setattr(jaccard, "settle", lambda df, name: steps.append(name) or settle(df, name))
    monkeypatch.setattr(jaccard, "ids_filter", lambda df, ids, key, how: held.append(ids.count()) or common.ids_filter(df, ids, key, how))
    monkeypatch.setattr(common, "BROADCAST_IDS", 150)
    monkeypatch.setattr(jaccard, "PASS_BYTES", 20_000)
    assert sorted(tuple(r) for r in jaccard.similar_components(docs).collect()) == want
    assert steps.count("verified") > 4 and max(held) <= 150
    steps.clear()
    monkeypatch.setattr(common, "BROADCAST_IDS", 400_000)
    monkeypatch.setattr(jaccard, "PASS_PAIRS", 400)
    assert sorted(tuple(r) for r in jaccard.similar_components(docs).collect()) == want
    assert steps.count("verified") > 1


def test_blocks_in_passes(spark, monkeypatch):
    """Links across components are the same whether buckets travel at once or in passes."""
    docs = settle(_near_copies(spark, 4, 12), "docs")
    ids = docs.select("doc_id", (F.col("doc_id") % 3).alias("key"), F.col("doc_id").alias("c"))
    named = settle(ids.join(jaccard.token_sets(docs, ids.select("doc_id"), 5).select("doc_id", "n"), "doc_id"), "named")
    links = lambda: sorted(tuple(r) for r in jaccard.cross_links(named, docs, 5, 80, all_links=True).collect())
    want = links()
    steps = []
    monkeypatch.setattr(jaccard, "settle", lambda df, name: steps.append(name) or settle(df, name))
    monkeypatch.setattr(jaccard, "PASS_BYTES", 4_000)
    monkeypatch.setattr(common, "BROADCAST_IDS", 20)
    assert links() == want and want
    assert steps.count("joining") > 1 and steps.count("sets") > 1


def test_settled_tables_go_when_read(spark):
    root = common.scratch_root(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(root))
    out = jaccard.similar_components(_near_copies(spark))
    left = {x.split("-")[0] for x in set(os.listdir(root)) - before}
    assert "slim" in left and not left & {"scan", "met", "alone", "keys", "sets"}
    assert out.count() == 12 * 40
