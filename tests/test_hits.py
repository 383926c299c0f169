"""Hits of a search are told apart by what the result shows."""


def test_code_search_counts_a_file_once(spark):
    from larkspan.operators import retrieval as R

    rows = [("a/net.py", "brand 1 net", 1), ("a/net.py", "brand 2 net", 1), ("a/net.py", "brand 2 net", 2), ("b/tower.py", "tower", 1), ("c/x.py", "tower net", 1), ("c/x.py", "x", 1)]
    files = spark.createDataFrame(rows, "path string, label string, chapter int")
    queries = spark.createDataFrame([(0, ""), (1, "tower")], "qid int, query string")
    got = {(r.qid, r["rank"]): (r.path, r.score) for r in R.code_search(queries, files, 4).collect()}
    # one row of each path and chapter, whatever its labels
    assert [got.get((0, i)) for i in range(1, 6)] == [("a/net.py", 1), ("b/tower.py", 1), ("c/x.py", 1), ("a/net.py", 1), None]
    assert [got.get((1, i)) for i in range(1, 4)] == [("b/tower.py", 30), ("c/x.py", 20), None]


def test_rank_joins_no_texts(spark, small):
    """What meets the scores of BM25 has numbers only, no texts and no vectors."""
    from larkspan.plans import text

    def joins(plan):
        below = plan.children()
        found = [plan] if plan.nodeName() == "Join" and plan.joinType().toString() == "LeftOuter" else []
        return found + [x for i in range(below.size()) for x in joins(below.apply(i))]

    met = joins(text.q9(spark, small)._jdf.queryExecution().optimizedPlan())
    names = [{j.left().output().apply(i).name() for i in range(j.left().output().size())} for j in met]
    assert len(met) == 3 and not any(n & {"_b", "_v", "_s", "_q", "_qt", "_qv"} for n in names)
