"""Queries on events: labels, as-of joins, windows, behaviour features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import behaviour as B
from ..operators import temporal as O
from ..session import table
from .registry import query
from .tables import AGE, EV, NOW, age_days, events

_ACT = "CASE WHEN event_type = 'view' THEN 'watch' ELSE event_type END"


def _action():
    return F.when(F.col("event_type") == "view", "watch").otherwise(F.col("event_type"))


def _feedback(spark, d):
    e = events(spark, d).where("event_type in ('click', 'purchase')")
    return e.select("user_id", "item", (F.col("event_type") == "purchase").cast("int").alias("label"), "ts", "event_id")


@query("w1_latest_label", f"""WITH {EV} SELECT user_id, item, label, event_id FROM (
    SELECT user_id, item, CAST(event_type = 'purchase' AS INT) AS label, event_id,
           row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, event_id DESC) AS rn
    FROM ev WHERE event_type IN ('click', 'purchase')) WHERE rn = 1""")
def w1(spark, d):
    return O.latest_by(_feedback(spark, d), ["user_id", "item"], F.col("ts"), F.col("event_id")).select("user_id", "item", "label", "event_id")


@query("j1_label_join", f"""WITH {EV},
    l AS (SELECT * FROM (SELECT user_id, item, CAST(event_type = 'purchase' AS INT) AS label, row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, event_id DESC) AS rn
          FROM ev WHERE event_type IN ('click', 'purchase')) WHERE rn = 1),
    f AS (SELECT * FROM (SELECT user_id, item, value AS feature, row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, event_id DESC) AS rn
          FROM ev WHERE event_type = 'view') WHERE rn = 1)
    SELECT f.user_id, f.item, feature, label FROM f JOIN l ON f.user_id = l.user_id AND f.item = l.item""")
def j1(spark, d):
    views = events(spark, d).where("event_type = 'view'").select("user_id", "item", F.col("value").alias("feature"), "ts", "event_id")
    views = O.latest_by(views, ["user_id", "item"], F.col("ts"), F.col("event_id")).select("user_id", "item", "feature")
    return O.label_join(views, _feedback(spark, d), ["user_id", "item"], [F.col("ts"), F.col("event_id")]).select("user_id", "item", "feature", "label")


def _sides(spark, d):
    e = events(spark, d)
    labels = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("label_ts"), F.col("event_id").alias("label_id"))
    feats = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("feature_ts"), F.col("event_id").alias("feature_id"), F.col("value").alias("feature"))
    return labels, feats


@query("j2_asof_join", f"""WITH {EV} SELECT l.event_id AS label_id, l.user_id, f.event_id AS feature_id, f.value AS feature
    FROM (SELECT * FROM ev WHERE event_type = 'purchase') l ASOF JOIN (SELECT * FROM ev WHERE event_type = 'view') f ON l.user_id = f.user_id AND l.ts >= f.ts""")
def j2(spark, d):
    labels, feats = _sides(spark, d)
    return O.asof_join(labels, feats, "user_id", "label_ts", "feature_ts", "feature_id").select("label_id", "user_id", "feature_id", "feature")


@query("j3_asof_available", f"""WITH {EV},
    f AS (SELECT *, ts + (event_id % 48) * INTERVAL 1 HOUR AS avail FROM ev WHERE event_type = 'view')
    SELECT label_id, user_id, feature_id FROM (SELECT l.event_id AS label_id, l.user_id, f.event_id AS feature_id,
           row_number() OVER (PARTITION BY l.event_id ORDER BY f.ts DESC, f.event_id) AS rn
    FROM ev l JOIN f ON l.user_id = f.user_id AND f.avail <= l.ts WHERE l.event_type = 'purchase') WHERE rn = 1""")
def j3(spark, d):
    labels, feats = _sides(spark, d)
    feats = feats.withColumn("avail", F.timestamp_micros(F.unix_micros("feature_ts") + F.col("feature_id") % 48 * 3_600_000_000))
    return O.asof_join(labels, feats, "user_id", "label_ts", "feature_ts", "feature_id", available="avail").select("label_id", "user_id", "feature_id")


@query("j17_interval_join", f"""WITH {EV} SELECT a.event_id AS request, b.event_id AS feedback FROM ev a JOIN ev b ON a.user_id = b.user_id
    AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def j17(spark, d):
    e = events(spark, d)
    a = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("request"), F.col("ts").alias("rt"))
    b = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("feedback"), F.col("ts").alias("ft"))
    return O.interval_join(a, b, ["user_id"], "rt", "ft", 6 * 3600).select("request", "feedback")


def _windows_sql():
    parts = []
    for w in (1, 7, 30):
        parts += [f"count(*) FILTER (age <= {w} AND action IN ('click', 'watch')) AS click_{w}d", f"round(coalesce(avg(value) FILTER (age <= {w} AND action = 'watch'), 0), 6) AS watch_{w}d"]
    return f"WITH {EV} SELECT user_id, {', '.join(parts)} FROM (SELECT *, {AGE} AS age, {_ACT} AS action FROM ev) GROUP BY user_id"


def _features(spark, d):
    return B.window_features(events(spark, d), "user_id", age_days(), _action(), F.col("value"))


@query("ag5_window_features", _windows_sql())
def ag5(spark, d):
    f = _features(spark, d)
    return f.select(*[F.round(c, 6).alias(c) if c.startswith("watch") else c for c in f.columns])


_DECAY = f"""dk AS (SELECT user_id, sum(CASE WHEN action IN ('click', 'watch') THEN exp(-0.1 * age) ELSE 0 END) AS decayed_clicks,
    sum(CASE WHEN action = 'watch' THEN exp(-0.1 * age) * value ELSE 0 END) AS decayed_watch, count(*) FILTER (action IN ('click', 'watch')) AS plain
    FROM (SELECT *, {AGE} AS age, {_ACT} AS action FROM ev) WHERE age >= 0 GROUP BY user_id)"""


def _decayed(spark, d):
    return B.decayed_sums(events(spark, d), "user_id", age_days(), _action(), F.col("value"))


@query("ag6_decayed_sums", f"WITH {EV}, {_DECAY} SELECT user_id, round(decayed_clicks, 6) AS decayed_clicks, round(decayed_watch, 6) AS decayed_watch FROM dk")
def ag6(spark, d):
    return _decayed(spark, d).select("user_id", *[F.round(c, 6).alias(c) for c in ("decayed_clicks", "decayed_watch")])


@query("ag7_engagement", f"""WITH {EV}, x AS (SELECT user_id, count(*) FILTER (age <= 30 AND action IN ('click', 'watch')) AS clicks,
    coalesce(avg(value) FILTER (age <= 30 AND action = 'watch'), 0) AS watch, min(age) AS rec FROM (SELECT *, {AGE} AS age, {_ACT} AS action FROM ev) GROUP BY user_id)
    SELECT user_id, round(clicks / 30.0, 6) AS frequency, clicks / 30.0 > 0.5 AS frequent, rec < 3 AS recent, watch > 20 AS intense FROM x""")
def ag7(spark, d):
    recency = events(spark, d).groupBy("user_id").agg(F.max_by(age_days(), F.struct("ts", "event_id")).alias("recency"))
    out = B.engagement_labels(_features(spark, d).join(recency, "user_id"), "click_30d", 30, "recency", "watch_30d")
    return out.select("user_id", F.round("frequency", 6).alias("frequency"), "frequent", "recent", "intense")


@query("ag8_rank_change", f"""WITH {EV}, {_DECAY}, r AS (SELECT user_id, row_number() OVER (ORDER BY plain DESC, user_id) AS before,
    row_number() OVER (ORDER BY round(decayed_clicks, 6) DESC, user_id) AS "after" FROM dk)
    SELECT user_id, before, "after", before - "after" AS moved FROM r""")
def ag8(spark, d):
    plain = events(spark, d).where(age_days() >= 0).groupBy("user_id").agg(F.count_if(_action().isin("click", "watch")).alias("plain"))
    s = plain.join(_decayed(spark, d), "user_id").withColumn("decayed_clicks", F.round("decayed_clicks", 6))
    return B.rank_change(s, "user_id", "plain", "decayed_clicks").select("user_id", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"), F.col("moved").cast("long").alias("moved"))


@query("ag9_leaderboard_overlap", f"""WITH {EV}, {_DECAY}, a AS (SELECT user_id FROM dk ORDER BY plain DESC, user_id LIMIT 20),
    b AS (SELECT user_id FROM dk ORDER BY round(decayed_clicks, 6) DESC, user_id LIMIT 20)
    SELECT count(*) AS overlap, count(*) / 20.0::DOUBLE AS share FROM a JOIN b USING (user_id)""")
def ag9(spark, d):
    plain = events(spark, d).where(age_days() >= 0).groupBy("user_id").agg(F.count_if(_action().isin("click", "watch")).alias("plain"))
    s = plain.join(_decayed(spark, d), "user_id").withColumn("decayed_clicks", F.round("decayed_clicks", 6))
    return B.leaderboard_overlap(s, "user_id", "plain", "decayed_clicks", 20)


@query("ag10_share_entropy", f"""WITH {EV}, c AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY ALL),
    p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c)
    SELECT user_id, max(event_type) FILTER (rn = 1) AS top, round(max(p), 6) AS top_share, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY user_id""")
def ag10(spark, d):
    c = events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return B.share_entropy(c, ["user_id"], "event_type", "n").select("user_id", "top", F.round("top_share", 6).alias("top_share"), F.round("entropy", 6).alias("entropy"))


@query("ag11_session_features", f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
      lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM ev), l AS (SELECT * FROM r WHERE rn <= 10),
    c AS (SELECT user_id, event_type, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c),
    e AS (SELECT user_id, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY user_id)
    SELECT l.user_id, count(*) AS events, round(avg(value), 6) AS mean_value, round(avg(epoch(ts) - epoch(prev)), 3) AS mean_gap, max(entropy) AS entropy FROM l JOIN e USING (user_id) GROUP BY l.user_id""")
def ag11(spark, d):
    from pyspark.sql import Window as W

    e = events(spark, d).withColumn("gap", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(W.partitionBy("user_id").orderBy("ts", "event_id"))) / 1e6)
    last = O.top_k(e, ["user_id"], 10, F.desc("ts"), F.desc("event_id"))
    ent = B.share_entropy(last.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id"], "event_type", "n")
    base = last.groupBy("user_id").agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.avg("gap"), 3).alias("mean_gap"))
    return base.join(ent.select("user_id", F.round("entropy", 6).alias("entropy")), "user_id")


@query("ag12_freshness", f"""WITH {EV}, m AS (SELECT event_type, (epoch(TIMESTAMP '2024-01-15') - epoch(ts)) // 60 AS age FROM ev),
    l AS (SELECT unnest([0, 60, 360, 1440]) AS lag)
    SELECT event_type, CAST(lag AS INT) AS lag, count(*) FILTER (age >= lag) AS visible, count(*) AS actual, round(count(*) FILTER (age >= lag) / count(*), 6) AS coverage
    FROM m, l WHERE age >= 0 AND age < 2880 GROUP BY event_type, lag""")
def ag12(spark, d):
    base = F.unix_timestamp(F.lit("2024-01-15").cast("timestamp"))
    e = events(spark, d).withColumn("minute", -F.floor((base - F.unix_micros("ts") / 1e6) / 60))
    return B.freshness_coverage(e, ["event_type"], "minute", 0, [0, 60, 360, 1440], 2880).withColumn("coverage", F.round("coverage", 6))


@query("ag13_inventory", """SELECT 'text' AS feature, count(text) / count(*) AS coverage, count(DISTINCT text) AS cardinality FROM documents
    UNION ALL SELECT 'lang', count(lang) / count(*), count(DISTINCT lang) FROM documents
    UNION ALL SELECT 'source', count(source) / count(*), count(DISTINCT source) FROM documents""")
def ag13(spark, d):
    return B.inventory(table(spark, d, "documents"), ["text", "lang", "source"])


_POS = """ps AS (SELECT l_linenumber AS position, count(*) AS exposures, avg(l_quantity) AS m FROM lineitem GROUP BY 1)"""


@query("ag14_position_report", f"""WITH {_POS} SELECT position, exposures, round(exposures / sum(exposures) OVER (), 6) AS share, round(m, 6) AS mean,
    round(m / first_value(m) OVER (ORDER BY position), 6) AS relative FROM ps""")
def ag14(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("position"), "l_quantity")
    return B.position_report(li, "position", "l_quantity").select("position", "exposures", *[F.round(c, 6).alias(c) for c in ("share", "mean", "relative")])


@query("ag15_decay_rate", f"WITH {_POS} SELECT round(-regr_slope(ln(m), position), 8) AS rate FROM ps")
def ag15(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("position"), "l_quantity")
    return B.decay_rate(B.position_report(li, "position", "l_quantity"), "position", "mean").select(F.round("rate", 8).alias("rate"))


@query("ag16_correlations", """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_quantity, l_tax) AS c, corr(l_extendedprice, l_discount) AS d,
      corr(l_extendedprice, l_tax) AS e, corr(l_discount, l_tax) AS f FROM lineitem),
    u AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, a AS r FROM c UNION ALL SELECT 'l_quantity', 'l_discount', b FROM c UNION ALL SELECT 'l_quantity', 'l_tax', c FROM c
      UNION ALL SELECT 'l_extendedprice', 'l_discount', d FROM c UNION ALL SELECT 'l_extendedprice', 'l_tax', e FROM c UNION ALL SELECT 'l_discount', 'l_tax', f FROM c)
    SELECT a, b, round(r, 6) AS r FROM u WHERE abs(r) > 0.0001""")
def ag16(spark, d):
    out = B.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.0001)
    return out.select("a", "b", F.round("r", 6).alias("r"))


@query("ag23_head_share", """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
    r AS (SELECT *, sum(n) OVER (ORDER BY n DESC, l_partkey ROWS UNBOUNDED PRECEDING) AS mass, row_number() OVER (ORDER BY n DESC, l_partkey) AS rn, sum(n) OVER () AS total FROM c)
    SELECT min(rn) FILTER (mass >= 0.9 * total) AS head_keys, count(*) AS all_keys FROM r""")
def ag23(spark, d):
    return B.head_share(table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), "l_partkey", "n")


@query("ag28_bucket_counter", f"""WITH {EV}, t AS (SELECT item, ts, CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id // 7 END AS dd FROM ev),
    o AS (SELECT item, min(ts) AS ts FROM t WHERE dd <> -1 GROUP BY item, dd UNION ALL SELECT item, ts FROM t WHERE dd = -1),
    a AS (SELECT item, (epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 3600 AS age FROM o)
    SELECT item, count(*) FILTER (age BETWEEN 0 AND 1) AS count_1h, count(*) FILTER (age BETWEEN 0 AND 24) AS count_24h, count(*) FILTER (age BETWEEN 0 AND 168) AS count_168h FROM a GROUP BY item""")
def ag28(spark, d):
    e = events(spark, d).select("item", "ts", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.floor(F.col("event_id") / 7)).alias("dedup"), F.lit(1).alias("delta"))
    return B.bucket_counts(e, ["item"], "ts", "dedup", "delta", F.lit(NOW).cast("timestamp"))


@query("ag29_smoothed_ctr", f"""WITH {EV} SELECT item, round((count(*) FILTER (event_type = 'click') + 2.0) / (count(*) FILTER (event_type = 'view') + 100), 8) AS ctr FROM ev GROUP BY item""")
def ag29(spark, d):
    c = events(spark, d).groupBy("item").agg(F.count_if(F.col("event_type") == "view").alias("s"), F.count_if(F.col("event_type") == "click").alias("c"))
    return c.select("item", F.round(B.smoothed_ctr(F.col("s"), F.col("c")), 8).alias("ctr"))


@query("w2_last_per_key", f"""WITH {EV} SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM ev GROUP BY ALL""".replace("max_by(event_id, (ts, event_id))", "arg_max(event_id, ts)"))
def w2(spark, d):
    return O.latest_by(events(spark, d).select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], F.col("ts"), F.col("event_id")).drop("ts")


@query("w3_carry_forward", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS carried FROM conversations""")
def w3(spark, d):
    c = table(spark, d, "conversations").withColumn("x", F.when(F.col("role") == "user", F.length("text").cast("long")))
    return O.carry_forward(c, ["conv_id"], ["turn"], "x", "carried").select("conv_id", "turn", "carried")


@query("w4_next_start", """SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS "end" FROM conversations WHERE role = 'user'""")
def w4(spark, d):
    return O.next_start(table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn"), ["conv_id"], "turn")


@query("w5_bounded_history", f"""WITH {EV} SELECT event_id, array_to_string(list(item) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), ',') AS history FROM ev""")
def w5(spark, d):
    h = O.bounded_history(events(spark, d), ["user_id"], ["ts", "event_id"], "item", 50, "h")
    return h.select("event_id", F.when(F.size("h") > 0, F.array_join(F.transform("h", lambda x: x.cast("string")), ",")).alias("history"))


@query("w6_session_window", f"""WITH {EV} SELECT event_id, array_to_string(list(item) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ',') AS session FROM ev""")
def w6(spark, d):
    h = O.bounded_history(events(spark, d), ["user_id"], ["ts", "event_id"], "item", 10, "h", current=True)
    return h.select("event_id", F.array_join(F.transform("h", lambda x: x.cast("string")), ",").alias("session"))


@query("w7_time_lookback", f"""WITH {EV} SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM ev)
    WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""")
def w7(spark, d):
    e = events(spark, d).withColumn("s", F.unix_timestamp("ts"))
    e = O.lookback(e, ["user_id"], "s", 86400, F.count("*"), "n")
    return O.lookback(e, ["user_id"], "s", 86400, F.sum("value"), "t").select("event_id", "n", F.round("t", 4).alias("total"))


@query("w8_stale_snapshot", f"""WITH {EV}, r AS (SELECT event_id, user_id, date_trunc('day', ts) AS b, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS fresh FROM ev)
    SELECT event_id, fresh, min(fresh) OVER (PARTITION BY user_id, b) AS stale FROM r""")
def w8(spark, d):
    e = O.snapshot_counts(events(spark, d), ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), "stale")
    return O.snapshot_counts(e, ["user_id"], ["ts", "event_id"], F.col("event_id"), "fresh").select("event_id", "fresh", "stale")


@query("w10_position_weights", f"""WITH {EV}, r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS i FROM ev)
    SELECT event_id, round(1.0 / i, 8) AS reciprocal, round(exp(-(i - 1.0)), 8) AS exponential FROM r""")
def w10(spark, d):
    from ..operators.funnel import position_weights

    e = O.top_k(events(spark, d), ["user_id"], 1 << 30, F.desc("value"), F.col("event_id"))
    a, b = position_weights(F.col("rank"))
    return e.select("event_id", F.round(a, 8).alias("reciprocal"), F.round(b, 8).alias("exponential"))


@query("w11_checkpoint_groups", """SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5 AS "group" FROM conversations""")
def w11(spark, d):
    return O.groups_of(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 5)


@query("w12_islands", """WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS n FROM lineitem), g AS (SELECT *, n - row_number() OVER (PARTITION BY s ORDER BY n) AS g FROM p)
    SELECT s AS l_suppkey, min(n) AS "first", max(n) AS "last" FROM g GROUP BY s, g""")
def w12(spark, d):
    return O.islands(table(spark, d, "lineitem"), ["l_suppkey"], "l_partkey")


@query("pf5_feature_time", f"""WITH {EV}, x AS (SELECT event_id, event_type = 'view' AS selected, epoch(ts) + (event_id % 5 - 3) * 3600 AS ft, epoch(ts) AS lt FROM ev)
    SELECT event_id, NOT (selected AND ft > lt) AS ok FROM x""")
def pf5(spark, d):
    from ..operators.contracts import feature_time_ok

    lt = F.unix_micros("ts") / 1e6
    e = events(spark, d).select("event_id", (F.col("event_type") == "view").alias("selected"), lt.alias("label_time"), (lt + (F.col("event_id") % 5 - 3) * 3600).alias("feature_time"))
    return e.select("event_id", feature_time_ok().alias("ok"))


@query("pf10_leakage_gate", f"""WITH {EV} SELECT l.event_id AS label_id, f.event_id AS feature_id
    FROM (SELECT * FROM ev WHERE event_type = 'purchase') l ASOF JOIN (SELECT * FROM ev WHERE event_type = 'view') f ON l.user_id = f.user_id AND l.ts >= f.ts""")
def pf10(spark, d):
    from ..operators.contracts import reject_leaks

    labels, feats = _sides(spark, d)
    joined = O.asof_join(labels, feats, "user_id", "label_ts", "feature_ts", "feature_id")
    return reject_leaks(joined, "label_ts", "feature_ts").where("feature_ts is not null").select("label_id", "feature_id")


@query("g5_cooccurrence", f"""WITH {EV}, h AS (SELECT event_id, item, unnest(list_distinct(list(item) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))) AS other FROM ev),
    e AS (SELECT event_id, item AS src, other AS dst FROM h WHERE item <> other UNION ALL SELECT event_id, other, item FROM h WHERE item <> other)
    SELECT src, dst, count(DISTINCT event_id) AS weight FROM e GROUP BY ALL""")
def g5(spark, d):
    from ..operators.graph import cooccurrence

    return cooccurrence(events(spark, d), "user_id", "item", ["ts", "event_id"], 5)


@query("st2_last_id_weights", f"""WITH {EV}, x AS (SELECT event_id, item AS src, user_id AS dst, event_id // 40 AS eid FROM ev),
    y AS (SELECT *, lag(eid) OVER (PARTITION BY src, dst ORDER BY event_id) AS p FROM x) SELECT src, dst, count(*) FILTER (p IS NULL OR p <> eid) AS weight FROM y GROUP BY ALL""")
def st2(spark, d):
    from ..streaming.stateful import last_id_weights

    e = events(spark, d).select("event_id", F.col("item").alias("src"), F.col("user_id").alias("dst"), F.floor(F.col("event_id") / 40).alias("eid"))
    return last_id_weights(e, "event_id", "eid")


@query("st6_windowed_counts", f"""WITH {EV} SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS start, event_type, count(*) AS n FROM ev GROUP BY ALL""")
def st6(spark, d):
    from ..streaming.stateful import windowed_counts

    return windowed_counts(events(spark, d), "ts", ["event_type"], "6 hours").select(F.unix_micros("window.start").alias("start"), "event_type", "n")


@query("st10_merge_labels", f"""WITH {EV} SELECT user_id, item, max(CAST(event_type = 'purchase' AS INT)) AS bought, round(sum(value), 4) AS spent FROM ev GROUP BY ALL""")
def st10(spark, d):
    from ..streaming.stateful import merge_labels

    e = events(spark, d).select("user_id", "item", (F.col("event_type") == "purchase").cast("int").alias("bought"), F.col("value").alias("spent"))
    return merge_labels(e, ["user_id", "item"], ["bought"], ["spent"]).withColumn("spent", F.round("spent", 4))


@query("st11_sessions", f"""WITH {EV}, x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM ev),
    y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM y GROUP BY user_id, g""")
def st11(spark, d):
    from ..streaming.stateful import sessions

    return sessions(events(spark, d), "ts", "user_id", "2 hours").select("user_id", F.unix_micros("session_window.start").alias("start"), "n")
