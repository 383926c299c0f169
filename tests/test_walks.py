"""Walks by blocks, against plain sums: hubs, sparse graphs, several blocks, nodes without an edge, ids of any size."""

import random
from collections import Counter

import pytest

from larkspan.operators import graph, walks


def _graph(seed):
    rng = random.Random(seed)
    nodes = [-5, 0, 3, 2**40, 2**62, *range(100, 140)]
    edges = {(rng.choice(nodes), rng.choice(nodes)): rng.randint(1, 9) for _ in range(150)}
    edges |= {(100, n): 2 for n in nodes} | {(n, 100): 1 for n in nodes[:20]}  # a hub
    edges |= {(101, 777): 3, (777, 778): 1, (None, 5): 1, (102, None): 4}  # 778 leads nowhere, and so does null
    return [(s, d, w) for (s, d), w in edges.items()]


def _ranks(edges, seeds, steps, restart=0.15):
    total = Counter()
    for s, _, w in edges:
        total[s] += w
    now = {s: {s: 1.0} for s in seeds}
    for _ in range(steps):
        new = {}
        for seed, at in now.items():
            moved = Counter()
            for s, d, w in edges:
                if s is not None and s in at:
                    moved[d] += at[s] * w / total[s] * (1 - restart)
            if moved:
                new[seed] = Counter(moved)
                new[seed][seed] += 1 - sum(moved.values())
        now = new
    return {(seed, i): x for seed, at in now.items() for i, x in at.items()}


@pytest.mark.parametrize("full, small", [(50, False), (1e9, True), (0, True)])
def test_pagerank(spark, monkeypatch, full, small):
    monkeypatch.setattr(walks, "FULL", full)
    if small:
        for name, value in (("CELL_PATHS", 100), ("SMALL_CELL", 50), ("CELL_ROWS", 20), ("STEP", 30 if full == 0 else 400)):
            monkeypatch.setattr(walks, name, value)
    edges = _graph(3)
    seeds = [100, 101, 102, 2**62, -5, 777, 778, 4242, *range(110, 130)]
    e = spark.createDataFrame(edges, "src long, dst long, weight long")
    s = spark.createDataFrame([(x,) for x in [*seeds, None]], "seed long")
    for steps in (1, 3):
        got = graph.personalised_pagerank(e, s, steps).collect()
        found = {(r.seed, r.id): r.score for r in got}
        assert len(got) == len(found) and found == {k: pytest.approx(v, abs=1e-12) for k, v in _ranks(edges, seeds, steps).items()}
    assert graph.personalised_pagerank(e, s.limit(0), 2).count() == 0
    assert graph.personalised_pagerank(e.limit(0), s, 2).count() == 0


def test_no_row_for_a_path(spark):
    """300 seeds and 300 targets meet in ten nodes: 900,000 paths of two steps for 90,000 results."""
    u, i = spark.range(300).selectExpr("id as u"), spark.range(1000, 1010).selectExpr("id as i")
    w = u.crossJoin(i)
    e = w.selectExpr("u as src", "i as dst", "1L as weight").unionByName(w.selectExpr("i as src", "u as dst", "1L as weight"))
    out = graph.personalised_pagerank(e, u.withColumnRenamed("u", "seed"), 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sum(" not in plan.split("MapInArrow")[0]
    got = out.selectExpr("count(*) as n", "sum(score) as s", "count(distinct seed, id) as d").first()
    # from a seed to the ten nodes and itself, then to every seed and the nodes again
    assert got.n == got.d == 300 * 310 and got.s == pytest.approx(300)
