"""Swing by lists that travel to ranges of users, against plain counts: repeats, long lists, several ranges and passes,
users that fill several steps, ids of any size."""

import random
from collections import Counter
from itertools import combinations

import pytest

from larkspan.operators import blocks, cf, overlap


def _rows(seed):
    rng = random.Random(seed)
    users = [-3, 1, 2, 3, 2**40, 70_000, 8, *range(100, 130)]
    items = [-7, 5, 300, 2**50, 2**33 + 1, 66_000, 11, 12, 13, *range(20, 60)]
    rows = [(rng.choice(users), rng.choice(items)) for _ in range(170)] + [(u, 5) for u in users] + [(1, i) for i in items]
    return rows + rows[:40] + [(None, 5), (1, None), (None, None), (999, 2**41), (998, 998), (998, 997)]


def _swing(rows):
    lists = {}
    for u, i in rows:
        if u is not None and i is not None:
            lists.setdefault(u, set()).add(i)
    sims = Counter()
    for mine in lists.values():
        for i in mine:
            sims.update({(i, j): 0.0 for j in mine if i != j})
    for u, v in combinations(lists, 2):
        both = lists[u] & lists[v]
        for i in both:
            sims.update({(i, j): 1 / (5 + len(both)) for j in both if i != j})
    return sims


def _near(sims, k):
    out = {}
    for i in {i for i, _ in sims}:
        order = sorted((-round(s, 9), j) for (x, j), s in sims.items() if x == i)[:k]
        out |= {(i, r): j for r, (_, j) in enumerate(order, 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_swing(spark, monkeypatch, small):
    if small:
        for name, value in (("PIECE", 3), ("RANGE_PAIRS", 60), ("STEP", 5), ("PASS_PAIRS", 200), ("PASS_SHARE", 1), ("HELD", 4)):
            monkeypatch.setattr(overlap, name, value)
        monkeypatch.setattr(cf, "MET_ROWS", 100)
    rows = _rows(7)
    pairs = spark.createDataFrame(rows, "user long, item long")
    want = _swing(rows)
    assert {(r.item, r.other): pytest.approx(r.sim) for r in cf.swing_similarity(pairs).collect()} == dict(want)
    for k in (3, 12):
        found = cf.swing_similarity(pairs, k=k, digits=9).collect()
        assert {(r.item, r["rank"]): r.other for r in found} == _near(want, k)
        assert all(r.sim == pytest.approx(want[r.item, r.other]) for r in found)


def test_lists_over_batches(spark, monkeypatch):
    """A list that goes on over several batches of Arrow, with repeats at their ends, and ends with one."""
    monkeypatch.setattr(overlap, "PIECE", 4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = [(u // 2, 1) for u in range(46)] + [(3, 2), (4, 2), (9, 3)] + [(u, 4) for u in range(8)]
        got = overlap.lists(spark.createDataFrame(rows, "user long, item long").repartition(1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    lists = {}
    for r in sorted(got, key=lambda r: (r.item, r.piece)):
        assert 0 < len(r.users) <= 4 and r.piece * 4 == len(lists.get(r.item, []))
        lists.setdefault(r.item, []).extend(r.users)
    assert lists == {1: list(range(23)), 2: [3, 4], 3: [9], 4: list(range(8))}


def test_no_row_for_a_pair_of_users(spark, monkeypatch):
    """One item of 2000 users makes two million pairs of users: none is a row of any step."""
    rows = []

    def settled(df, name, real=blocks.settled):
        out = real(df, name)
        rows.append(out.count())
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "(u#" not in plan
        return out

    monkeypatch.setattr(blocks, "settled", settled)
    pairs = spark.range(2000).selectExpr("id as user", "1L as item").unionByName(spark.range(20).selectExpr("id as user", "2L as item"))
    found = cf.swing_similarity(pairs, k=10, digits=9)
    assert {(r.item, r.other): round(r.sim, 6) for r in found.collect()} == {(1, 2): round(190 / 7, 6), (2, 1): round(190 / 7, 6)}
    assert rows and max(rows) < 5000
    assert cf.swing_similarity(pairs.limit(0), k=10, digits=9).count() == 0
