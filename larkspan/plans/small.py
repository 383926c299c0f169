"""Queries on literal records and on small tables: contracts, verdicts, progress, reviews, graphs, arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import contracts as C
from ..operators import funnel, graph, progress
from ..session import table
from .registry import query

_PH = ("baseline", "fault", "recovery")


@query("pf6_serving_contract", """SELECT o_orderkey, o_totalprice <= 150000 AND o_orderkey % 7 > 0 AS ok FROM orders""")
def pf6(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.lit(150000.0).alias("budget_ms"), F.col("o_totalprice").alias("elapsed_ms"), (F.col("o_orderkey") % 7).alias("candidates"))
    return o.select("o_orderkey", C.serving_ok().alias("ok"))


@query("pf7_release_contract", """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'fault' ELSE 'recovery' END AS phase, o_orderkey % 2 AS a, o_orderkey % 4 % 2 AS b, o_custkey % 2 AS c, o_orderstatus = 'O' AS acc FROM orders)
    SELECT o_orderkey, CASE WHEN phase = 'fault' THEN (a = b AND b = c) = acc ELSE (a = b AND b = c) AND acc END AS ok FROM x""")
def pf7(spark, d):
    k = F.col("o_orderkey")
    phase = F.when(k % 3 == 0, "baseline").when(k % 3 == 1, "fault").otherwise("recovery")
    o = table(spark, d, "orders").select("o_orderkey", phase.alias("phase"), (k % 2).alias("model_release"), (k % 4 % 2).alias("embedding_release"), (F.col("o_custkey") % 2).alias("index_release"), (F.col("o_orderstatus") == "O").alias("accepted"))
    return o.select("o_orderkey", C.releases_ok().alias("ok"))


@query("pf8_contract_rollup", """SELECT 'failed' AS status, '2' AS failed, 3::BIGINT AS records""")
def pf8(spark, d):
    rows = [("baseline", 100.0, 100.0, True, 1), ("fault", 100.0, 101.0, True, 2), ("recovery", 100.0, 101.0, False, 3)]
    r = spark.createDataFrame(rows, "phase string, label_time double, feature_time double, selected boolean, record int")
    out = C.check(r, C.feature_time_ok())
    return out.select("status", F.array_join(F.transform("failed", lambda x: x.cast("string")), ",").alias("failed"), "records")


@query("pf9_verdict", """SELECT * FROM (VALUES ('a', 'fault_not_reproduced'), ('b', 'baseline_or_recovery_failed'), ('c', 'command_failed'), ('d', 'fault_reproduced_and_recovered')) t(name, verdict)""")
def pf9(spark, d):
    sets = {"a": (True, True, True, False), "b": (True, False, False, False), "c": (True, False, True, True), "d": (True, False, True, False)}
    out = None
    for name, (*oks, crashed) in sets.items():
        p = spark.createDataFrame([(x, ok, crashed and x == "fault") for x, ok in zip(_PH, oks)], "phase string, ok boolean, command_failed boolean")
        v = C.verdict(p).select(F.lit(name).alias("name"), "verdict")
        out = v if out is None else out.unionByName(v)
    return out


@query("pf12_quantity", """SELECT * FROM (VALUES ('10k', 10000.0::DOUBLE), ('200ms', 200.0), ('1e8 items', 100000000.0), ('2s', 2000.0), ('5%', 5.0), ('x', NULL)) t(raw, value)""")
def pf12(spark, d):
    r = spark.createDataFrame([(x,) for x in ("10k", "200ms", "1e8 items", "2s", "5%", "x")], "raw string")
    return r.select("raw", T.quantity(F.col("raw")).alias("value"))


@query("pf13_constraints", """SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'size' ELSE '' END AS missing, CASE WHEN p_partkey % 3 = 0 THEN 'price' ELSE '' END AS invalid FROM part""")
def pf13(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("size"), F.when(F.col("p_partkey") % 3 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice")).alias("price"))
    g = C.constraint_gaps(p, ["size", "price"], ["price"])
    return g.select("id", F.array_join("missing", ",").alias("missing"), F.array_join("invalid", ",").alias("invalid"))


@query("pf14_required_fields", """SELECT doc_id AS id, array_to_string(list_filter(['and', 'license', 'the'], lambda x: NOT regexp_matches(text, x)), ',') AS missing FROM documents""")
def pf14(spark, d):
    rules = spark.createDataFrame([("the", "the"), ("license", "license"), ("and", "and")], "name string, pattern string")
    return C.required_fields(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), rules).select("id", F.array_join("missing", ",").alias("missing"))


@query("pf17_review_validation", """WITH r AS (SELECT o_orderkey AS id, 'T' || (o_custkey % 9) AS task_id, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS label, CAST(o_custkey % 40 AS VARCHAR) AS reviewer, o_orderkey % 4 AS s, o_totalprice - 20000 AS t FROM orders),
    e AS (SELECT id, CASE WHEN task_id = 'T8' THEN 'task,' ELSE '' END || CASE WHEN s > 2 THEN 'score,' ELSE '' END || CASE WHEN t < 0 THEN 'time,' ELSE '' END || CASE WHEN count(*) OVER (PARTITION BY task_id, label, reviewer) > 1 THEN 'duplicate,' ELSE '' END AS errors FROM r)
    SELECT id, errors FROM e WHERE errors <> ''""")
def pf17(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = table(spark, d, "orders").select(
        k.alias("id"), F.concat(F.lit("T"), (c % 9).cast("string")).alias("task_id"), F.when(k % 2 == 0, "A").otherwise("B").alias("label"), (c % 40).cast("string").alias("reviewer"),
        (k % 4).alias("correctness"), (F.col("o_totalprice") - 20000).alias("first_success_seconds"),
    )
    out = C.review_errors(r, ["correctness"], [f"T{i}" for i in range(8)])
    return out.select("id", F.concat(F.array_join("errors", ","), F.lit(",")).alias("errors"))


@query("pf19_path_policy", """SELECT url AS path FROM pages WHERE regexp_matches(url, '\\?') OR NOT starts_with(url, 'https://')""")
def pf19(spark, d):
    return C.path_policy(table(spark, d, "pages").select(F.col("url").alias("path")), ["https://"], [r"\?"])


@query("pf20_slice_intake", """SELECT event_id FROM events WHERE user_id % 5 > 0 AND epoch(TIMESTAMP '2024-01-16') - floor(epoch(ts)) <= 86400 AND value > 10""")
def pf20(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("author_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("value") > 10, F.col("value")).alias("vec"))
    return C.valid_slices(e, F.lit("2024-01-16 00:00:00").cast("timestamp"), 1440).select("event_id")


@query("pf21_log_intake", """SELECT event_id, coalesce(CASE WHEN user_id % 3 > 0 THEN CAST(user_id AS VARCHAR) END, CASE WHEN event_id % 2 = 0 THEN 'd' || event_id END) AS actor FROM events WHERE user_id % 3 > 0 OR event_id % 2 = 0""")
def pf21(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("d"), F.col("event_id").cast("string"))).alias("device_id"))
    return C.with_identity(e).select("event_id", "actor")


_NODES = "ABCDEFGH"
_EDGES = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E"), ("F", "G")]


def _graph(spark):
    return spark.createDataFrame([(x,) for x in _NODES], "id string"), spark.createDataFrame(_EDGES, "src string, dst string")


def _log(spark):
    rows = [
        (1, "c1", "u1", "A", "completed", 0.9, "2024-01-08", None), (2, "c1", "u1", "F", "assessed", 0.4, None, None), (3, "c1", "u2", "B", "completed", 0.8, "2024-01-20", None),
        (4, "c1", "u2", "A", "passed", 0.9, None, "review"), (5, "c2", "v1", "C", "assessed", 0.5, None, None), (6, "c2", "v1", "C", "assessed", 0.7, None, None), (7, "c2", "v2", "H", "completed", 0.85, "2024-01-09", None),
    ]
    return spark.createDataFrame(rows, "seq int, course_id string, unit_id string, concept_id string, status string, score double, review_due string, action string").withColumn("topic", F.lit(None).cast("string"))


def _units(spark):
    return spark.createDataFrame([("c1", "u1", 1), ("c1", "u2", 2), ("c1", "u3", 3), ("c2", "v1", 1), ("c2", "v2", 2)], "course_id string, unit_id string, ord int")


@query("j7_prerequisite_frontier", """SELECT * FROM (VALUES ('C'), ('F')) t(id)""")
def j7(spark, d):
    return graph.frontier(*_graph(spark), progress.completed(_log(spark)))


@query("tk5_recommended_next", """SELECT * FROM (VALUES ('F', 0.4::DOUBLE), ('C', 0.7)) t(id, score)""")
def tk5(spark, d):
    return progress.recommended_next(_log(spark), *_graph(spark))


@query("j8_due_reviews", """SELECT * FROM (VALUES ('H', '2024-01-09')) t(concept_id, review_due)""")
def j8(spark, d):
    return progress.due_reviews(_log(spark), F.lit("2024-01-15").cast("date"))


@query("j9_one_hop", """SELECT n_nationkey AS id, 100 + n_regionkey AS other, 'prerequisite' AS relation FROM nation WHERE n_nationkey < 5""")
def j9(spark, d):
    e = table(spark, d, "nation").select((F.col("n_regionkey") + 100).alias("src"), F.col("n_nationkey").alias("dst"))
    return graph.neighbours(e, e.where("dst < 5").select(F.col("dst").alias("id")))


@query("j10_neighbourhood", """WITH e AS (SELECT DISTINCT l_suppkey AS src, 1000000000 + l_partkey AS dst FROM lineitem), g AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 50 = 0 UNION ALL SELECT 1000000000 + p_partkey FROM part WHERE p_partkey % 50 = 0)
    SELECT count(*) FILTER (src IN (FROM g) AND dst IN (FROM g)) AS inner_edges, count(DISTINCT src) FILTER (dst IN (FROM g) AND src NOT IN (FROM g)) AS before, count(DISTINCT dst) FILTER (src IN (FROM g) AND dst NOT IN (FROM g)) AS "after" FROM e""")
def j10(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000000).alias("dst")).distinct()
    suppliers = table(spark, d, "supplier").where("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("id"))
    return graph.neighbourhood(e, suppliers.unionByName(table(spark, d, "part").where("p_partkey % 50 = 0").select((F.col("p_partkey") + 1000000000).alias("id"))))


@query("j13_integrity", """SELECT 'card_missing' AS problem, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)
    UNION ALL SELECT DISTINCT 'edge_end_unknown', o_custkey + 1000000000 FROM orders""")
def j13(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    o = table(spark, d, "orders")
    edges = o.select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 1000000000).alias("dst"))
    return graph.integrity(nodes, edges, o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id")).distinct())


@query("j14_bridge_join", """SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 2)""")
def j14(spark, d):
    n = table(spark, d, "nation").where("n_regionkey in (1, 2)").select("n_nationkey")
    return table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(F.broadcast(n), "n_nationkey").select("s_suppkey", "n_nationkey")


@query("g1_cycle_edges", """SELECT * FROM (VALUES ('b', 'c'), ('c', 'd'), ('d', 'b')) t(src, dst)""")
def g1(spark, d):
    return graph.on_cycles(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "e"), ("f", "a")], "src string, dst string"))


@query("g2_mermaid", """SELECT 'graph TD' || chr(10) || '  A --> B' || chr(10) || '  A --> C' || chr(10) || '  B --> D' || chr(10) || '  C --> D' || chr(10) || '  D --> E' || chr(10) || '  F --> G' || chr(10) || '  H' AS text""")
def g2(spark, d):
    return graph.mermaid(*_graph(spark))


@query("ag19_self_evaluation", """SELECT 7::BIGINT AS records, 3::BIGINT AS completed_records, 3::BIGINT AS completed_keys, 0.721429::DOUBLE AS mean_score""")
def ag19(spark, d):
    return progress.self_evaluation(_log(spark)).withColumn("mean_score", F.round("mean_score", 6))


@query("ag20_overview", """SELECT * FROM (VALUES ('c1', 3::BIGINT, 2::BIGINT, 4), ('c2', 2, 1, 7)) t(course_id, units, completed, last_seq)""")
def ag20(spark, d):
    return progress.overview(_log(spark), _units(spark))


@query("w13_current_unit", """SELECT * FROM (VALUES ('c1', 'u3', 3), ('c2', 'v1', 1)) t(course_id, unit_id, ord)""")
def w13(spark, d):
    return progress.current_unit(_log(spark), _units(spark))


@query("w11_unit_checkpoints", """SELECT * FROM (VALUES ('u1', 'u1-1', 'a,b,c,d,e'), ('u1', 'u1-2', 'f,g')) t(unit_id, checkpoint, concepts)""")
def w11(spark, d):
    u = spark.createDataFrame([("u1", list("abcdefg"))], "unit_id string, concepts array<string>")
    return progress.checkpoints(u).withColumn("concepts", F.array_join("concepts", ","))


@query("ag21_review_summary", """SELECT * FROM (VALUES ('t1', 'A', 'old', 2::BIGINT, 5.0::DOUBLE, 30.0::DOUBLE, 5, ''), ('t1', 'B', 'new', 3, 6.0, 40.0, 4, ''), ('t2', 'A', 'new', 2, 5.0, 20.0, 4, 'correctness')) t(task_id, label, "system", reviewers, median_score, median_seconds, agreements, open_conflicts)""")
def ag21(spark, d):
    fields = ["correctness", "evidence", "completeness", "actionability", "boundary"]
    settled = {"correctness": (["r1", "r2"], 2, "checked")}
    rows = [
        (1, "t1", "A", "r1", *[1] * 5, 20.0, None), (2, "t1", "A", "r2", *[1] * 5, 40.0, None),
        (3, "t1", "B", "r1", 0, 1, 1, 1, 1, 30.0, None), (4, "t1", "B", "r2", 2, 1, 1, 1, 1, 40.0, None), (5, "t1", "B", "r3", 2, 1, 1, 1, 1, 50.0, settled),
        (6, "t2", "A", "r1", 0, 1, 1, 1, 1, 10.0, None), (7, "t2", "A", "r2", 2, 1, 1, 1, 1, 30.0, None),
    ]
    schema = "seq int, task_id string, label string, reviewer string, " + ", ".join(f"{f} int" for f in fields) + ", first_success_seconds double, adjudications map<string, struct<reviewers: array<string>, score: int, reason: string>>"
    assign = spark.createDataFrame([("t1", "A", "old"), ("t1", "B", "new"), ("t2", "A", "new"), ("t2", "B", "old")], "task_id string, label string, system string")
    out = progress.review_summary(spark.createDataFrame(rows, schema), assign, fields)
    return out.withColumn("open_conflicts", F.array_join("open_conflicts", ","))


@query("ag17_feature_costs", """WITH f AS (SELECT p_brand AS feature, count(*)::DOUBLE AS a, sum(p_size)::DOUBLE AS b, round(avg(p_retailprice), 6) AS g FROM part GROUP BY 1), t AS (SELECT feature, a + b + 3.0 * a AS cost, g AS gain FROM f),
    m AS (SELECT list_sort(list(cost))[count(*) // 2 + 1] AS mc, list_sort(list(gain))[count(*) // 2 + 1] AS mg, sum(cost) AS al FROM t)
    SELECT feature, round(cost, 4) AS cost, round(gain / cost, 6) AS roi, CASE WHEN gain >= mg THEN 'high' ELSE 'low' END || '_gain_' || CASE WHEN cost >= mc THEN 'high' ELSE 'low' END || '_cost' AS quadrant, round(cost / al, 6) AS share FROM t, m""")
def ag17(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.count("*").cast("double").alias("a"), F.sum("p_size").cast("double").alias("b"), F.round(F.avg("p_retailprice"), 6).alias("g"))
    out = funnel.feature_costs(p.withColumn("l", F.col("a")), "feature", ["a", "b"], "l", 3.0, "g")
    return out.select("feature", F.round("cost", 4).alias("cost"), F.round("roi", 6).alias("roi"), "quadrant", F.round("share", 6).alias("share"))


@query("ag22_overload", """SELECT * FROM (VALUES (100, 80, 20, 80, 20, 0.2::DOUBLE, 20), (100, 80, 100, 0, 100, 1.0, 5), (1, 1, 3, 1, 0, 0.0, 3)) t(requests, capacity, dependency_ms, personalized, fallback, fallback_rate, p99_ms)""")
def ag22(spark, d):
    return funnel.simulate_serving(spark.createDataFrame([(100, 80, 20), (100, 80, 100), (1, 1, 3)], "requests int, capacity int, dependency_ms int"), 50)


@query("q13_p99", """WITH x AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1) SELECT l_suppkey, v[greatest(0, CAST(floor(len(v) * 0.99) AS INT) - 1) + 1] AS p99 FROM x""")
def q13(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(funnel.upper_index_quantile(F.col("l_extendedprice"), 0.99).alias("p99"))


@query("ag24_weighted_criteria", """WITH s AS (SELECT p_brand AS k, p_type AS dim, avg(p_size) AS sc FROM part GROUP BY ALL), w AS (SELECT p_type AS dim, CAST(min(length(p_type)) AS DOUBLE) AS wt FROM part GROUP BY 1)
    SELECT 'len' AS profile, k AS brand, round(sum(wt * sc) / sum(wt), 6) AS total FROM s JOIN w USING (dim) GROUP BY k""")
def ag24(spark, d):
    p = table(spark, d, "part")
    s = p.groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("dim")).agg(F.avg("p_size").alias("sc"))
    w = p.groupBy(F.col("p_type").alias("dim")).agg(F.min(F.length("p_type")).cast("double").alias("wt")).withColumn("profile", F.lit("len"))
    return funnel.weighted_criteria(s, w, "brand", "dim", "sc", "profile", "wt").select("profile", "brand", F.round("total", 6).alias("total"))


@query("ag25_vector_costs", """SELECT * FROM (VALUES (1000000000::BIGINT, 128::BIGINT, 128000000000::BIGINT, 12.8::DOUBLE, 512000000000::BIGINT, 128000000000::BIGINT, 8000000000::BIGINT)) t(n, d, ops, seconds, float32, "int8", pq)""")
def ag25(spark, d):
    return spark.createDataFrame([(1_000_000_000, 128)], "n long, d long").select("n", "d", *N.vector_costs(F.col("n"), F.col("d")))


@query("ag27_sequences", """WITH s AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS q, first(role ORDER BY turn) AS h FROM conversations GROUP BY 1) SELECT h AS head, count(*) AS n, count(DISTINCT q) AS distinct_sequences FROM s GROUP BY 1""")
def ag27(spark, d):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    s = table(spark, d, "conversations").groupBy("conv_id").agg(roles.alias("q"))
    return s.groupBy(F.get("q", F.lit(0)).alias("head")).agg(F.count("*").alias("n"), F.countDistinct("q").alias("distinct_sequences"))


@query("fn_apportion", """SELECT * FROM (VALUES (1, 60, 1, 15::BIGINT), (1, 60, 2, 18), (1, 60, 3, 18), (1, 60, 4, 9), (2, 7, 1, 2), (2, 7, 2, 2), (2, 7, 3, 2), (2, 7, 4, 1)) t(k, total, ord, share)""")
def apportion(spark, d):
    rows = [(k, t, i + 1, w) for k, t in ((1, 60), (2, 7)) for i, w in enumerate((25, 30, 30, 15))]
    return N.apportion(spark.createDataFrame(rows, "k int, total int, ord int, w int"), ["k"], "total", "w", "ord").select("k", "total", "ord", "share")


@query("fn_latency_budget", """SELECT * FROM (VALUES ('gateway', 10.0::DOUBLE, 2000::BIGINT), ('retrieval', 30.0, 2000), ('prerank', 60.0, 2000), ('rank', 60.0, 2000), ('rerank', 10.0, 2000), ('reserve', 30.0, 2000)) t(stage, ms, in_flight)""")
def latency(spark, d):
    r = spark.createDataFrame([(10_000.0, 200.0)], "qps double, p99 double")
    return r.select(F.explode(N.latency_budget(F.col("p99"))).alias("b"), N.in_flight(F.col("qps"), F.col("p99")).alias("in_flight")).select("b.stage", "b.ms", "in_flight")


@query("j16_blind_mapping", """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS "system", count(*) AS n FROM orders GROUP BY 1""")
def j16(spark, d):
    m = spark.createDataFrame([("A", "old"), ("B", "new")], "label string, system string")
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("B").alias("label"))
    return o.join(F.broadcast(m), "label").groupBy("system").agg(F.count("*").alias("n"))


@query("so4_intersection", """SELECT p_partkey, p_type LIKE '%A%' AND p_brand LIKE '%1%' AS both FROM part""")
def so4(spark, d):
    marks = F.filter(F.array(F.when(F.col("p_type").contains("A"), "a"), F.when(F.col("p_brand").contains("1"), "b")), lambda x: x.isNotNull())
    return table(spark, d, "part").select("p_partkey", F.size(F.array_intersect(marks, F.array(F.lit("a"), F.lit("b")))).alias("n")).select("p_partkey", (F.col("n") == 2).alias("both"))


@query("st5_bounded_list", """WITH x AS (SELECT user_id, event_id, ts, max(ts) OVER (PARTITION BY user_id) AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS items FROM x WHERE rn <= 5 AND ts > m - INTERVAL 2 DAY GROUP BY 1""")
def st5(spark, d):
    from ..operators.temporal import top_k

    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    e = e.join(e.groupBy("user_id").agg(F.max("ts").alias("m")), "user_id").where(F.col("ts") > F.col("m") - F.expr("interval 2 days"))
    last = top_k(e, ["user_id"], 5, F.desc("ts"), F.desc("event_id")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("l"))
    return last.select("user_id", F.array_join(F.transform("l", lambda x: x["event_id"].cast("string")), ",").alias("items"))


@query("st8_inverted_lists", """WITH x AS (SELECT p_brand AS tag, p_partkey AS item, p_size AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rn FROM part WHERE p_partkey % 9 <> 0)
    SELECT tag, string_agg(CAST(item AS VARCHAR), ',' ORDER BY rn) AS items FROM x WHERE rn <= 10 GROUP BY 1""")
def st8(spark, d):
    from ..streaming.stateful import inverted_lists

    p = table(spark, d, "part")
    base = p.select(F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("score"), F.array("p_brand").alias("tags"), F.lit(False).alias("deleted"), F.lit(1).alias("seq"))
    gone = base.where("item % 9 = 0").withColumns({"deleted": F.lit(True), "seq": F.lit(2)})
    return inverted_lists(base.unionByName(gone), 10).select("tag", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("st9_latest_vectors", """SELECT label AS item, max(vec_id) AS slice_id FROM embeddings GROUP BY 1""")
def st9(spark, d):
    from ..streaming.stateful import latest_vectors

    v = table(spark, d, "embeddings").select(F.col("label").alias("item"), F.col("vec_id").alias("slice_id"), F.col("vec_id").alias("ts"), F.col("embedding").alias("vec"))
    return latest_vectors(v.unionByName(v)).select("item", "slice_id")


@query("st7_changed_counters", """WITH b AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY 1), a AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT a.user_id, a.n FROM a LEFT JOIN b USING (user_id) WHERE a.n IS DISTINCT FROM b.n""")
def st7(spark, d):
    from ..streaming.stateful import changed_counters

    e = table(spark, d, "events")
    return changed_counters(e.where("event_id % 10 != 0").groupBy("user_id").agg(F.count("*").alias("n")), e.groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"])


@query("fn_entities", """SELECT * FROM (VALUES (1, 'cf'), (2, 'cf,filter'), (3, ''), (4, 'rerank'), (5, 'rank')) t(qid, families)""")
def entities(spark, d):
    families = [("alias", "cf", ["cf", "协同过滤"]), ("alias", "filter", ["filter", "过滤"]), ("alias", "rerank", ["rerank", "re-ranking"]), ("alias", "rank", ["rank", "ranking"])]
    q = spark.createDataFrame([(1, "协同过滤"), (2, "协同过滤再做过滤"), (3, "pre-rankingx"), (4, "re-ranking"), (5, "ranking")], "qid int, query string")
    return T.resolve_entities(q, families).select("qid", F.array_join(F.transform("matches", lambda x: x["family"]), ",").alias("families"))


@query("sc10_pipe_table", """SELECT * FROM (VALUES ('a', '1', 'b', 'c'), ('d', '22', 'e', 'f')) t(c0, c1, c2, c3)""")
def sc10(spark, d):
    from ..sources.files import pipe_rows

    lines = spark.createDataFrame([("| a | 1 | b | c |",), ("|---|---|---|---|",), ("| x | y |",), ("| d | 22 | e | f |",), ("text",)], "line string")
    return pipe_rows(lines).select(*[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(4)])


@query("sc9_front_matter", """SELECT 'as-of' AS id, '7' AS chapter, 'body text' AS body""")
def sc9(spark, d):
    from ..sources.files import front_matter, markdown_section

    t = spark.createDataFrame([("---\nid: as-of\nchapter: 7\n---\n# T\n## Basis\nbody text\n## Next\nmore",)], "text string")
    return t.select(front_matter(F.col("text"), "id").alias("id"), front_matter(F.col("text"), "chapter").alias("chapter"), markdown_section(F.col("text"), "Basis").alias("body"))


@query("pf15_submission_diagnosis", r"""SELECT doc_id AS id, CASE WHEN regexp_matches(text, 'license|License') THEN 'placeholder,' ELSE '' END || CASE WHEN length(regexp_replace(text, '\s+', '', 'g')) < 600 THEN 'short,' ELSE '' END
    || CASE WHEN regexp_matches(text, '(?m)^\s*[0-9]+[.)]\s*\S') THEN '' ELSE 'answers,' END AS findings FROM documents""")
def pf15(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return C.diagnose(docs, "license|License", 600, 1).select("id", F.array_join(F.transform("findings", lambda x: F.concat(x, F.lit(","))), "").alias("findings"))


@query("pf16_unreleased", """SELECT * FROM (VALUES (1, 23), (3, 99), (7, 0), (8, 40)) t(qid, chapter)""")
def pf16(spark, d):
    asked = ["第二十三章的PDF", "第3章和第十章的页码", "完整原书第九十九章", "协同过滤 pdf", "第九十九章讲了什么", "第三十章PDF尚未发布吗", "第零章pdf", "已发布的第十章和第四十章", "第十十章PDF", "第百章PDF"]
    q = spark.createDataFrame(list(enumerate(asked, 1)), "qid int, query string")
    released = spark.range(1, 23).select(F.col("id").cast("int").alias("chapter"))
    return C.unreleased_references(q, released)


_STEM = r"regexp_replace(regexp_extract(path, '([^/]+)/*$', 1), '[.][^.]*$', '')"


@query("q_code_relevance", rf"""WITH f AS (SELECT replace(p_name, ' ', '_') || '/' || lower(p_type) || '-' || p_partkey % 13 || '.py' AS path, lower(p_brand || ' ' || p_name) AS label, CAST(p_partkey % 20 AS INT) AS chapter FROM part),
    q AS (SELECT * FROM (VALUES (0, 'eco'), (1, 'economy'), (2, 'promo'), (3, 'widget'), (4, 'standard 7'), (5, '12'), (6, 'large promo'), (7, '')) t(qid, query)),
    n AS (SELECT DISTINCT qid, query, path, label, chapter, translate(lower({_STEM}), '_-', '  ') AS name, length(query) < 4 AS short FROM f, q),
    w AS (SELECT *, string_split(name, ' ') AS ws, list_distinct(regexp_extract_all(query, '[a-z][a-z0-9_-]+')) AS ts FROM n),
    b AS (SELECT *, CASE WHEN short THEN CASE WHEN list_contains(ws, query) THEN 28 ELSE 0 END WHEN contains(name, query) THEN 28 WHEN len(list_filter(ws, lambda x: starts_with(x, query))) > 0 THEN 12 WHEN contains(label, query) THEN 20 ELSE 0 END AS base,
      2 * len(list_filter(ts, lambda t: contains(name, t))) AS extra FROM w),
    s AS (SELECT DISTINCT qid, path, chapter, CASE WHEN query = '' THEN 1 WHEN short AND base = 0 THEN 0 ELSE base + extra END AS score FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chapter, path) AS rank FROM s WHERE score > 0) SELECT qid, path, score, rank FROM r WHERE rank <= 8""")
def code(spark, d):
    from ..operators.retrieval import code_search

    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("/"), F.lower("p_type"), F.lit("-"), (F.col("p_partkey") % 13).cast("string"), F.lit(".py"))
    f = table(spark, d, "part").select(name.alias("path"), F.concat_ws(" ", "p_brand", "p_name").alias("label"), (F.col("p_partkey") % 20).cast("int").alias("chapter")).distinct()
    q = spark.createDataFrame(list(enumerate(["eco", "economy", "promo", "widget", "standard 7", "12", "large promo", ""])), "qid int, query string")
    return code_search(q, f).select("qid", "path", "score", F.col("rank").cast("long").alias("rank"))


@query("w9_top_per_group", """SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3""")
def w9(spark, d):
    from ..operators.temporal import top_k

    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    out = top_k(li, ["l_suppkey"], 3, F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"))
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("sc1_json_lines", """SELECT CAST(doc_id AS VARCHAR) AS id, source, CAST(doc_id % 50 + 1 AS INT) AS page_start, length(text)::BIGINT AS chars FROM documents""")
def sc1(spark, d):
    from ..session import scratch_path
    from ..sources.files import read_chunks

    path = scratch_path(spark, "chunks")
    docs = table(spark, d, "documents")
    docs.select(F.col("doc_id").cast("string").alias("id"), "source", "text", (F.col("doc_id") % 50 + 1).cast("int").alias("page_start")).write.json(path)
    return read_chunks(spark, path).select("id", "source", "page_start", F.length("text").cast("long").alias("chars"))


@query("sc2_manifest", """SELECT 1 AS format, count(*) AS chunks, 20::BIGINT AS sources FROM documents""")
def sc2(spark, d):
    from ..session import scratch_path
    from ..sources.files import write_index
    from .tables import chunks

    c = chunks(spark, d)
    src = c.groupBy(F.col("source").alias("path")).agg(F.sha2(F.min("text").cast("binary"), 256).alias("sha256"), F.count("*").alias("size"))
    return write_index(c, scratch_path(spark, "index"), src).select("format", "chunks", F.size("sources").cast("long").alias("sources"))


@query("sc5_replay", """SELECT event_id, row_number() OVER (ORDER BY event_id) + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 0 END AS seq FROM events WHERE event_type = 'purchase'""")
def sc5(spark, d):
    from ..session import scratch_path
    from ..sources.files import append_events, replay

    path = scratch_path(spark, "log")
    e = table(spark, d, "events").where("event_type = 'purchase'").select("event_id", F.col("event_id").alias("ord"))
    append_events(e, path)
    return replay(spark, path, "event_id long, seq long")[0].select("event_id", "seq")


@query("sc12_partition_overwrite", """SELECT l_returnflag, CASE WHEN l_returnflag = 'R' THEN count(*) FILTER (l_linestatus = 'F') ELSE count(*) END AS n FROM lineitem GROUP BY 1""")
def sc12(spark, d):
    from ..session import scratch_path
    from ..sources.files import overwrite_partitions

    path = scratch_path(spark, "parts")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag")
    overwrite_partitions(li, path, "l_returnflag")
    overwrite_partitions(li.where("l_returnflag = 'R' and l_linestatus = 'F'"), path, "l_returnflag")
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count("*").alias("n"))
