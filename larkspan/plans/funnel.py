"""Queries on orders, lines and vectors: collaborative filtering, candidate funnel, top-k, set operations, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cf, funnel, metrics, retrieval
from ..operators import temporal as O
from ..session import table
from .registry import query
from .tables import EV, PAIRS, events, pairs, vectors


_ICF = """n AS (SELECT item, count(*) AS n FROM pr GROUP BY 1), m AS (SELECT "user", item, count(*) AS m FROM pr GROUP BY ALL),
    c AS (SELECT a.item, b.item AS other, sum(a.m * b.m) AS c FROM m a JOIN m b ON a."user" = b."user" AND a.item <> b.item GROUP BY ALL),
    sim AS (SELECT c.item, other, c / sqrt(x.n * y.n) AS sim FROM c JOIN n x ON x.item = c.item JOIN n y ON y.item = other)"""
_TOP = """tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(sim, 9) DESC, other) AS rank FROM sim) WHERE rank <= 10)"""
_UCF = """un AS (SELECT "user", count(*) AS n FROM pr GROUP BY 1), s AS (SELECT DISTINCT * FROM pr),
    uc AS (SELECT a."user", b."user" AS other, count(*) AS c FROM s a JOIN s b ON a.item = b.item AND a."user" <> b."user" GROUP BY ALL),
    us AS (SELECT uc."user", other, c / sqrt(x.n * y.n) AS sim FROM uc JOIN un x ON x."user" = uc."user" JOIN un y ON y."user" = other),
    ut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(sim, 9) DESC, other) AS rank FROM us) WHERE rank <= 10)"""


def _icf(spark, d):
    return cf.item_similarity(pairs(spark, d), 10, 9)


@query("j4_item_cf", f"WITH {PAIRS}, {_ICF}, {_TOP} SELECT item, other, round(sim, 6) AS sim, rank FROM tk")
def j4_item(spark, d):
    return _icf(spark, d).select("item", "other", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("ag4_item_cf_orders", f"""WITH {PAIRS}, {_ICF} SELECT item, other, round(sim, 6) AS sim FROM sim WHERE item < other""")
def ag4(spark, d):
    return cf.item_similarity(pairs(spark, d), half=True).select("item", "other", F.round("sim", 6).alias("sim"))


@query("ag3_similarity_sum", f"""WITH {PAIRS}, {_ICF}, {_TOP} SELECT "user", other AS item, round(sum(sim), 7) AS score FROM (SELECT DISTINCT * FROM pr) h JOIN tk USING (item) GROUP BY ALL""")
def ag3(spark, d):
    sums = cf.similarity_sums(pairs(spark, d), _icf(spark, d).select("item", "other", "sim"))
    return sums.select("user", "item", "score")


@query("j4_user_cf", f"""WITH {PAIRS}, {_UCF} SELECT "user", other, round(sim, 6) AS sim, rank FROM ut""")
def j4_user(spark, d):
    near = cf.user_similarity(pairs(spark, d), 10, 9)
    return near.select("user", "other", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


_SWING = """s AS (SELECT DISTINCT * FROM pr), uv AS (SELECT a."user" AS u, b."user" AS v, count(*) AS o FROM s a JOIN s b ON a.item = b.item AND a."user" < b."user" GROUP BY ALL),
    co AS (SELECT a.item, b.item AS other, a."user" AS u FROM s a JOIN s b ON a."user" = b."user" AND a.item <> b.item),
    sc AS (SELECT x.item, x.other, sum(1.0::DOUBLE / (5 + uv.o)) AS w FROM co x JOIN co y ON x.item = y.item AND x.other = y.other AND x.u < y.u JOIN uv ON uv.u = x.u AND uv.v = y.u GROUP BY ALL),
    sim AS (SELECT p.item, p.other, coalesce(w, 0) AS sim FROM (SELECT DISTINCT item, other FROM co) p LEFT JOIN sc USING (item, other))"""


@query("j5_swing", f"WITH {PAIRS}, {_SWING}, {_TOP} SELECT item, other, round(sim, 6) AS sim, rank FROM tk")
def j5(spark, d):
    near = cf.swing_similarity(pairs(spark, d), k=10, digits=9)
    return near.select("item", "other", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


_REC = """sc2 AS (SELECT h."user", t.other AS item, sum(t.sim) AS score FROM (SELECT DISTINCT * FROM pr) h JOIN tk t USING (item) GROUP BY ALL),
    nw AS (SELECT * FROM sc2 ANTI JOIN pr ON sc2."user" = pr."user" AND sc2.item = pr.item),
    rc AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(score, 7) DESC, item) AS rank FROM nw)"""


@query("j6_recall_item_cf", f"""WITH {PAIRS}, {_ICF}, {_TOP}, {_REC} SELECT "user", item, round(score, 7) AS score, rank FROM rc WHERE rank <= 10""")
def j6(spark, d):
    found = cf.recall_items(pairs(spark, d), _icf(spark, d).select("item", "other", "sim"), 10)
    return found.select("user", "item", "score", F.col("rank").cast("long").alias("rank"))


@query("j6_recall_user_cf", f"""WITH {PAIRS}, {_UCF}, sc AS (SELECT ut."user", s.item, sum(sim) AS score FROM ut JOIN s ON s."user" = ut.other GROUP BY ALL),
    nw AS (SELECT * FROM sc ANTI JOIN s ON sc."user" = s."user" AND sc.item = s.item)
    SELECT "user", item, round(score, 7) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(score, 7) DESC, item) AS rank FROM nw) WHERE rank <= 10""")
def j6_user(spark, d):
    p = pairs(spark, d)
    found = cf.recall_users(p, cf.user_similarity(p, 10, 9).select("user", "other", "sim"), 10)
    return found.select("user", "item", "score", F.col("rank").cast("long").alias("rank"))


def _buyers(spark, d):
    return events(spark, d).where("event_type = 'purchase'").select(F.col("user_id").alias("user")).distinct()


def _routes(spark, d):
    e = events(spark, d)
    popular = e.where("event_type = 'click'").groupBy("item").agg(F.count("*").alias("n"))
    hot = popular.orderBy(F.desc("n"), "item").limit(10)
    users = _buyers(spark, d)
    hot_route = users.crossJoin(F.broadcast(hot)).select("user", "item", (F.col("n") / 1000.0).alias("score"))
    fresh = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("user"), "item").agg((F.count("*") / 10.0).alias("score"))
    return {"view": fresh.join(users, "user", "left_semi"), "hot": hot_route}


_ROUTES = f"""{EV}, us AS (SELECT DISTINCT user_id AS "user" FROM ev WHERE event_type = 'purchase'),
    hot AS (SELECT item, count(*) AS n FROM ev WHERE event_type = 'click' GROUP BY 1 ORDER BY n DESC, item LIMIT 10),
    un AS (SELECT user_id AS "user", item, count(*) / 10.0::DOUBLE AS score, 'view' AS route, 0 AS route_no FROM ev WHERE event_type = 'view' AND user_id IN (SELECT "user" FROM us) GROUP BY 1, 2
      UNION ALL SELECT "user", item, n / 1000.0::DOUBLE, 'hot', 1 FROM us, hot),
    mg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user", item ORDER BY score DESC, route_no) AS rn FROM un) WHERE rn = 1)"""


@query("so1_union_routes", f"""WITH {_ROUTES} SELECT route, count(*) AS n, round(sum(score), 6) AS mass FROM un GROUP BY route""")
def so1(spark, d):
    return funnel.union_routes(_routes(spark, d)).groupBy("route").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("mass"))


@query("so2_merge_best", f"""WITH {_ROUTES} SELECT "user", item, round(score, 6) AS score, route FROM mg""")
def so2(spark, d):
    return funnel.merge_best(funnel.union_routes(_routes(spark, d))).select("user", "item", F.round("score", 6).alias("score"), "route")


@query("tk2_funnel", f"""WITH {_ROUTES}, tk AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM mg),
    l AS (SELECT "user", string_agg(CAST(item AS VARCHAR), ',' ORDER BY rank) AS items FROM tk WHERE rank <= 8 GROUP BY 1)
    SELECT us."user", CASE WHEN us."user" % 10 = 0 OR us."user" % 7 = 0 THEN '1,2,3' ELSE items END AS items, us."user" % 10 = 0 OR us."user" % 7 = 0 AS degraded,
      CASE WHEN us."user" % 10 = 0 THEN 'overload' WHEN us."user" % 7 = 0 THEN 'timeout' END AS reason FROM us LEFT JOIN l USING ("user")""")
def tk2(spark, d):
    users = _buyers(spark, d).withColumns({"over": F.col("user") % 10 == 0, "late": F.col("user") % 7 == 0})
    out = funnel.recommend(users, funnel.union_routes(_routes(spark, d)), [1, 2, 3], 8, "over", "late")
    return out.select("user", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "degraded", "reason")


@query("tk2_quota", f"""WITH {_ROUTES} SELECT "user", item, route FROM (SELECT *, row_number() OVER (PARTITION BY "user", route ORDER BY score DESC, item) AS rk FROM un) WHERE (route = 'view' AND rk <= 5) OR (route = 'hot' AND rk <= 3)""")
def tk2_quota(spark, d):
    return funnel.quota(funnel.union_routes(_routes(spark, d)), {"view": 5, "hot": 3}).select("user", "item", "route")


@query("tk4_over_scan", f"""WITH {EV}, e AS (SELECT user_id AS src, item AS dst, sum(value) AS weight FROM ev GROUP BY ALL),
    w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 6) DESC, dst) AS r FROM e) WHERE r <= 15 AND dst % 4 <> 0)
    SELECT src, dst, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 6) DESC, dst) AS rank FROM w) WHERE rank <= 3""")
def tk4(spark, d):
    e = events(spark, d).groupBy(F.col("user_id").alias("src"), F.col("item").alias("dst")).agg(F.round(F.sum("value"), 6).alias("weight"))
    visible = e.select(F.col("dst").alias("item")).distinct().where("item % 4 != 0")
    return funnel.over_scan(e, visible, 3).select("src", "dst", F.col("rank").cast("long").alias("rank"))


@query("st4_neighbour_query", f"""WITH {EV}, e AS (SELECT user_id AS src, item AS dst, sum(value) AS weight FROM ev GROUP BY ALL),
    q AS (SELECT user_id AS query, user_id AS src, CASE WHEN user_id % 9 = 0 THEN 201 ELSE 5 END AS want, user_id % 6 AS min_version FROM (SELECT DISTINCT user_id FROM ev)),
    g AS (SELECT *, want > 200 OR 4 < min_version AS degraded FROM q),
    l AS (SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY rk) AS items FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 6) DESC, dst) AS rk FROM e WHERE dst % 4 <> 0) WHERE rk <= 5 GROUP BY 1)
    SELECT query, degraded, CASE WHEN degraded THEN '' ELSE coalesce(items, '') END AS items FROM g LEFT JOIN l USING (src)""")
def st4(spark, d):
    e = events(spark, d).groupBy(F.col("user_id").alias("src"), F.col("item").alias("dst")).agg(F.round(F.sum("value"), 6).alias("weight"))
    visible = e.select(F.col("dst").alias("item")).distinct().where("item % 4 != 0")
    q = e.select(F.col("src").alias("query"), "src").distinct().select("query", "src", F.when(F.col("src") % 9 == 0, 201).otherwise(5).alias("want"), (F.col("src") % 6).alias("min_version"))
    out = funnel.neighbour_query(q, e, visible, 4)
    return out.select("query", "degraded", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("tk6_linear_fusion", """WITH f AS (SELECT p_partkey, round(0.2 * p_size + 0.3 * (p_retailprice / 100) + 0.5 * (p_partkey % 7), 6) AS fused FROM part)
    SELECT p_partkey, fused, row_number() OVER (ORDER BY fused DESC, p_partkey) AS rank FROM f QUALIFY rank <= 25""")
def tk6(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("a"), (F.col("p_retailprice") / 100).alias("b"), (F.col("p_partkey") % 7).alias("c"))
    f = funnel.linear_fusion(p, {"a": 0.2, "b": 0.3, "c": 0.5}).withColumn("fused", F.round("fused", 6))
    return f.orderBy(F.desc("fused"), "p_partkey").limit(25).select("p_partkey", "fused").transform(lambda x: O.top_k(x.withColumn("g", F.lit(1)), ["g"], 25, F.desc("fused"), F.col("p_partkey"))).select("p_partkey", "fused", F.col("rank").cast("long").alias("rank"))


@query("tk7_rearrangement", """WITH v AS (SELECT l_linenumber AS i, avg(l_quantity) AS s FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 6),
    a AS (SELECT i, s FROM v), t AS (SELECT a.s + b.s / 2 + c.s / 3 + d.s / 4 AS total FROM a, a b, a c, a d WHERE a.i <> b.i AND a.i <> c.i AND a.i <> d.i AND b.i <> c.i AND b.i <> d.i AND c.i <> d.i)
    SELECT count(*) AS permutations, round(max(total), 6) AS best, round((SELECT sum(s / rn) FROM (SELECT s, row_number() OVER (ORDER BY s DESC) AS rn FROM a) WHERE rn <= 4), 6) AS sorted_total FROM t""")
def tk7(spark, d):
    v = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("i")).agg(F.avg("l_quantity").alias("s")).orderBy("i").limit(6)
    a, b, c, e = (v.select(F.col("i").alias(f"i{n}"), F.col("s").alias(f"s{n}")) for n in range(4))
    t = a.join(b, F.col("i0") != F.col("i1")).join(c, (F.col("i2") != F.col("i0")) & (F.col("i2") != F.col("i1")))
    t = t.join(e, (F.col("i3") != F.col("i0")) & (F.col("i3") != F.col("i1")) & (F.col("i3") != F.col("i2")))
    best = t.agg(F.count("*").alias("permutations"), F.round(F.max(F.col("s0") + F.col("s1") / 2 + F.col("s2") / 3 + F.col("s3") / 4), 6).alias("best"))
    top = O.top_k(v.withColumn("g", F.lit(1)), ["g"], 4, F.desc("s"))
    return best.crossJoin(top.agg(F.round(F.sum(F.col("s") / F.col("rank")), 6).alias("sorted_total")))


@query("so3_changed_keys", """SELECT l_partkey AS k, 'removed' AS change FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R')
    UNION ALL SELECT l_partkey, 'added' FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def so3(spark, d):
    li = table(spark, d, "lineitem")
    a = li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")).distinct()
    b = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).distinct()
    return a.join(b, "k", "left_anti").withColumn("change", F.lit("removed")).unionByName(b.join(a, "k", "left_anti").withColumn("change", F.lit("added")))


@query("sc4_change_detection", """WITH p AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 3), c AS (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 5 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 4)
    SELECT CAST(coalesce(p.doc_id, c.doc_id) AS VARCHAR) AS path, CASE WHEN p.h IS NULL THEN 'added' WHEN c.h IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM p FULL JOIN c USING (doc_id) WHERE p.h IS NULL OR c.h IS NULL OR p.h <> c.h""")
def sc4(spark, d):
    from ..sources.files import changes

    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    before = docs.where("doc_id % 10 != 3").select("path", F.md5("text").alias("sha256"))
    after = docs.where("doc_id % 10 != 4").select("path", F.md5(F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("sha256"))
    return changes(before, after)


@query("so5_changed_known", """WITH a AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS k, p_size + CAST(p_partkey % 11 = 0 AS INT) AS v FROM part WHERE p_partkey % 7 <> 0)
    SELECT coalesce(a.k, b.k) AS k FROM a FULL JOIN b USING (k) WHERE (a.v IS DISTINCT FROM b.v) AND coalesce(a.k, b.k) IN (SELECT l_partkey FROM lineitem)""")
def so5(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_partkey % 5 != 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    b = p.where("p_partkey % 7 != 0").select(F.col("p_partkey").alias("k"), (F.col("p_size") + (F.col("p_partkey") % 11 == 0).cast("int")).alias("v"))
    moved = a.exceptAll(b).unionByName(b.exceptAll(a)).select("k").distinct()
    return moved.intersect(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")))


@query("so6_ordered_distinct", f"""WITH {EV}, x AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ev), f AS (SELECT user_id, item, min(rn) AS rn FROM x GROUP BY ALL)
    SELECT user_id, string_agg(CAST(item AS VARCHAR), ',' ORDER BY rn) AS items FROM f GROUP BY 1""")
def so6(spark, d):
    l = events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "item"))).alias("l"))  # noqa: E741
    return l.select("user_id", F.array_join(F.array_distinct(F.transform("l", lambda x: x["item"].cast("string"))), ",").alias("items"))


@query("so7_partition_check", """SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(s_suppkey) <> 4""")
def so7(spark, d):
    n, s = table(spark, d, "nation").select("n_nationkey"), table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return n.join(s, "n_nationkey", "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("n")).where("n != 4")


_KNN = """q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0), it AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT qid, id, list_cosine_similarity(q.v, it.v) AS sim FROM q, it), kn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM s)"""


@query("j15_knn", f"WITH {_KNN} SELECT qid, id, round(sim, 6) AS sim, rank FROM kn WHERE rank <= 5")
def j15(spark, d):
    v = vectors(spark, d)
    out = retrieval.knn(v.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec"), v, 5)
    return out.select("qid", "id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("pf11_version_gate", f"WITH {_KNN} SELECT qid, id, rank FROM kn WHERE rank <= 3 AND qid % 2 = 0")
def pf11(spark, d):
    from ..operators.contracts import version_gate

    v = vectors(spark, d)
    q = v.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec", F.when(F.col("id") % 2 == 0, "v2").otherwise("v1").alias("version"))
    return retrieval.knn(version_gate(q, "v2", "v2"), v, 3).select("qid", "id", F.col("rank").cast("long").alias("rank"))


@query("fn_vectors", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_reverse(CAST(embedding AS DOUBLE[])) AS r FROM embeddings),
    x AS (SELECT *, list_dot_product(v, v) AS n2, list_dot_product(v, r) AS d, [exp(a - list_max(v)) FOR a IN v] AS ex FROM e)
    SELECT vec_id, round(sqrt(n2), 6) AS norm, round(d / n2, 6) AS cosine, round(list_sum([a / sqrt(n2) FOR a IN v]), 6) AS unit_sum, round(list_max(ex) / list_sum(ex), 6) AS softmax_top,
      round(list_sum([greatest(a, 0) FOR a IN v]), 6) AS relu_sum, round(list_sum(v) * (0.25 + 0.75), 6) AS weighted, round(list_sum(v) * d + list_sum(v) + list_sum(r), 6) AS crossed FROM x""")
def vector_functions(spark, d):
    from ..functions import vectors as V

    v, r = F.col("v"), F.reverse("v")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    e = vectors(spark, d).select(F.col("id").alias("vec_id"), F.transform("vec", lambda x: x.cast("double")).alias("v"))
    out = {
        "norm": V.norm(v), "cosine": V.cosine(v, r), "unit_sum": total(V.unit(v)), "softmax_top": F.array_max(V.softmax(v)), "relu_sum": total(V.relu(v)),
        "weighted": total(V.weighted_sum([v, r], [F.lit(0.25), F.lit(0.75)])), "crossed": total(V.cross_layer(v, v, r, r)),
    }
    return e.select("vec_id", *[F.round(c, 6).alias(n) for n, c in out.items()])


@query("ag26_ivf_recall")
def ag26(spark, d):
    v = vectors(spark, d).select("id", "vec")
    q = v.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec")
    model, indexed = retrieval.ivf(v, 8)
    return retrieval.recall_at_k(retrieval.ivf_search(model, indexed, q, 5, 6), retrieval.knn(q, v, 5), 5)


@query("m_diversify")
def diversify(spark, d):
    v = vectors(spark, d).select("id", "vec")
    near = retrieval.knn(v.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec"), v, 30).join(v, "id")
    return metrics.diversify(near, "qid", "id", "sim", "vec", 5)


def _scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n"))
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "source", F.col("quality").alias("y"), F.round(F.col("n") % 997 / 997.0, 6).alias("p"))


_SC = """sc AS (SELECT l.doc_id, source, quality AS y, round(length(text) % 997 / 997.0, 6)::DOUBLE AS p FROM labels l JOIN documents USING (doc_id))"""


@query("m_classification", f"""WITH {_SC}, c AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y <> 1 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y <> 1 AND p < 0.5) AS tn FROM sc)
    SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def m_classification(spark, d):
    c = metrics.classification(_scored(spark, d), "y", "p", 0.5)
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("accuracy", "precision", "recall", "f1")])


@query("m_auc", f"""WITH {_SC}, x AS (SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS s, count(*) AS n FROM sc a, sc b WHERE a.y = 1 AND b.y = 0) SELECT round((s / n)::DOUBLE, 6) AS auc FROM x""")
def m_auc(spark, d):
    return metrics.auc(_scored(spark, d), "y", "p").select(F.round("auc", 6).alias("auc"))


@query("m_gauc", f"""WITH {_SC}, x AS (SELECT a.source, sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS auc FROM sc a JOIN sc b ON a.source = b.source WHERE a.y = 1 AND b.y = 0 GROUP BY 1),
    n AS (SELECT source, count(*) AS w FROM sc GROUP BY 1) SELECT round(sum(auc * w) / sum(w), 6) AS gauc, count(*) AS users FROM x JOIN n USING (source)""")
def m_gauc(spark, d):
    return metrics.gauc(_scored(spark, d), "y", "p", "source").withColumn("gauc", F.round("gauc", 6))


@query("m_calibration", f"""WITH {_SC}, b AS (SELECT least(9, floor(p * 10)) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my, sum(p) AS sp, sum(y) AS sy FROM sc GROUP BY 1)
    SELECT round(sum(sp) / sum(sy), 6) AS pcoc, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece, round(max(abs(mp - my)), 6) AS mce FROM b""")
def m_calibration(spark, d):
    return metrics.calibration(_scored(spark, d), "y", "p").select(*[F.round(x, 6).alias(x) for x in ("pcoc", "ece", "mce")])


@query("m_ranking", f"""WITH {_SC}, r AS (SELECT source, y::DOUBLE AS g, row_number() OVER (PARTITION BY source ORDER BY p DESC, doc_id) AS r, row_number() OVER (PARTITION BY source ORDER BY y DESC, doc_id) AS i FROM sc),
    h AS (SELECT *, sum(g) OVER (PARTITION BY source ORDER BY r) AS hits, sum(g) OVER (PARTITION BY source) AS al FROM r)
    SELECT source, round(coalesce(sum(CASE WHEN r <= 5 THEN g / log2(r + 1) END) / nullif(sum(CASE WHEN i <= 5 THEN g / log2(i + 1) END), 0), 0), 6) AS ndcg,
      round(coalesce(sum(CASE WHEN r <= 5 THEN g * hits / r END) / nullif(least(max(al), 5), 0), 0), 6) AS ap, round(coalesce(1.0 / min(CASE WHEN r <= 5 AND g > 0 THEN r END), 0), 6)::DOUBLE AS rr FROM h GROUP BY source""")
def m_ranking(spark, d):
    return metrics.ranking(_scored(spark, d), "source", "y", "p", "doc_id", 5).select("source", *[F.round(x, 6).alias(x) for x in ("ndcg", "ap", "rr")])


@query("m_psi", """WITH a AS (SELECT l_linenumber AS b, count(*) / sum(count(*)) OVER () AS e FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), c AS (SELECT l_linenumber AS b, count(*) / sum(count(*)) OVER () AS x FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
    SELECT round(sum((x - e) * ln(x / e)), 8) AS psi, round(sum(x * ln(x / e)), 8) AS kl FROM a JOIN c USING (b)""")
def m_psi(spark, d):
    li = table(spark, d, "lineitem")
    out = metrics.psi(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'N'"), "l_linenumber")
    return out.select(F.round("psi", 8).alias("psi"), F.round("kl", 8).alias("kl"))


@query("m_welch", """WITH s AS (SELECT avg(o_totalprice) FILTER (o_custkey % 2 = 0) AS cm, avg(o_totalprice) FILTER (o_custkey % 2 = 1) AS tm, var_samp(o_totalprice) FILTER (o_custkey % 2 = 0) AS cv, var_samp(o_totalprice) FILTER (o_custkey % 2 = 1) AS tv,
      count(*) FILTER (o_custkey % 2 = 0) AS cn, count(*) FILTER (o_custkey % 2 = 1) AS tn FROM orders)
    SELECT round(tm - cm, 4) AS diff, round((tm - cm) / sqrt(cv / cn + tv / tn), 6) AS t, round(pow(cv / cn + tv / tn, 2) / (pow(cv / cn, 2) / (cn - 1) + pow(tv / tn, 2) / (tn - 1)), 3) AS df FROM s""")
def m_welch(spark, d):
    o = table(spark, d, "orders").withColumn("arm", F.col("o_custkey") % 2)
    return metrics.welch(o, "arm", "o_totalprice", 0, 1).select(F.round("diff", 4).alias("diff"), F.round("t", 6).alias("t"), F.round("df", 3).alias("df"))


@query("m_two_proportions", """WITH s AS (SELECT count(*) FILTER (l_suppkey % 2 = 0) AS n1, count(*) FILTER (l_suppkey % 2 = 1) AS n2, count(*) FILTER (l_suppkey % 2 = 0 AND l_returnflag = 'R') AS x1, count(*) FILTER (l_suppkey % 2 = 1 AND l_returnflag = 'R') AS x2 FROM lineitem)
    SELECT round(x1 / n1, 8) AS control, round(x2 / n2, 8) AS treatment, round((x2 / n2 - x1 / n1) / sqrt((x1 + x2) / (n1 + n2) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 6) AS z FROM s""")
def m_two(spark, d):
    li = table(spark, d, "lineitem").withColumn("arm", F.col("l_suppkey") % 2)
    out = metrics.two_proportions(li, "arm", F.col("l_returnflag") == "R", 0, 1)
    return out.select(F.round("control", 8).alias("control"), F.round("treatment", 8).alias("treatment"), F.round("z", 6).alias("z"))


@query("m_sample_ratio", """WITH c AS (SELECT l_linenumber AS arm, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), e AS (SELECT *, sum(n) OVER () / count(*) OVER () AS e FROM c)
    SELECT round(sum(pow(n - e, 2) / e), 6) AS chi2, count(*) - 1 AS df FROM e""")
def m_srm(spark, d):
    c = table(spark, d, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_linenumber").alias("arm")).agg(F.count("*").alias("n")).withColumn("e", F.lit(1.0))
    return metrics.sample_ratio(c, "arm", "n", "e").withColumn("chi2", F.round("chi2", 6))


@query("m_concentration", """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS k, sum(n) OVER () AS t FROM c)
    SELECT round(2 * sum(i * n) / max(k * t) - max((k + 1) / k), 8) AS gini, round(-sum(n / t * ln(n / t)), 6) AS entropy, round(sum(pow(n / t, 2)), 10) AS hhi FROM r""")
def m_concentration(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return metrics.concentration(c, "n").select(F.round("gini", 8).alias("gini"), F.round("entropy", 6).alias("entropy"), F.round("hhi", 10).alias("hhi"))


@query("m_normalise", """SELECT p_partkey, round(CASE WHEN max(p_size) OVER w > min(p_size) OVER w THEN (p_size - min(p_size) OVER w) / (max(p_size) OVER w - min(p_size) OVER w) ELSE 0.5 END, 8)::DOUBLE AS normalised FROM part WINDOW w AS (PARTITION BY p_brand)""")
def m_normalise(spark, d):
    return metrics.normalise_scores(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size").select("p_partkey", F.round("normalised", 8).alias("normalised"))


@query("m_robust_z", """WITH m AS (SELECT p_brand, median(p_size) AS m FROM part GROUP BY 1), d AS (SELECT p_partkey, p_brand, p_size - m AS x FROM part JOIN m USING (p_brand)), a AS (SELECT p_brand, median(abs(x)) AS mad FROM d GROUP BY 1)
    SELECT p_partkey, round(x / nullif(1.4826 * mad, 0), 6)::DOUBLE AS robust_z FROM d JOIN a USING (p_brand)""")
def m_robust(spark, d):
    return metrics.robust_z(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size").select("p_partkey", F.round("robust_z", 6).alias("robust_z"))


@query("m_period_change", """WITH d AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, round((n - lag(n, 7) OVER (ORDER BY day)) / lag(n, 7) OVER (ORDER BY day), 6) AS change FROM d""")
def m_period(spark, d):
    daily = events(spark, d).groupBy(F.floor(F.unix_timestamp("ts") / 86400).alias("day")).agg(F.count("*").alias("n"))
    return metrics.period_change(daily, [], "day", "n", 7).select("day", "n", F.round("change", 6).alias("change"))


@query("g6_pagerank", f"""WITH {EV}, w AS (SELECT user_id AS u, 1000000000 + item AS i, count(*) AS w FROM ev GROUP BY ALL), e AS (SELECT u AS src, i AS dst, w FROM w UNION ALL SELECT i, u, w FROM w),
    m AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e), s0 AS (SELECT DISTINCT user_id AS seed, user_id AS id, 1.0::DOUBLE AS s FROM ev WHERE user_id % 50 = 0),
    s1 AS (SELECT seed, dst AS id, sum(0.85 * p * s) AS s FROM m JOIN s0 ON id = src GROUP BY ALL), n1 AS (SELECT seed, id, sum(s) AS s FROM (SELECT * FROM s1 UNION ALL SELECT seed, seed, 1 - sum(s) FROM s1 GROUP BY seed) GROUP BY ALL),
    s2 AS (SELECT seed, dst AS id, sum(0.85 * p * s) AS s FROM m JOIN n1 ON id = src GROUP BY ALL), n2 AS (SELECT seed, id, sum(s) AS s FROM (SELECT * FROM s2 UNION ALL SELECT seed, seed, 1 - sum(s) FROM s2 GROUP BY seed) GROUP BY ALL)
    SELECT seed, id, round(s, 8)::DOUBLE AS score FROM n2""")
def g6(spark, d):
    from ..operators.graph import personalised_pagerank

    # users and items have id ranges of their own; the walk goes both ways
    w = events(spark, d).groupBy(F.col("user_id").alias("u"), (F.col("item") + 1000000000).alias("i")).agg(F.count("*").alias("weight"))
    e = w.select(F.col("u").alias("src"), F.col("i").alias("dst"), "weight").unionByName(w.select(F.col("i").alias("src"), F.col("u").alias("dst"), "weight"))
    seeds = w.where("u % 50 = 0").select(F.col("u").alias("seed")).distinct()
    return personalised_pagerank(e, seeds, 2).select("seed", "id", F.round("score", 8).alias("score"))


@query("n_negative_samples")
def negatives(spark, d):
    p = pairs(spark, d)
    return cf.negative_samples(p, p.select("item").distinct(), 1)
