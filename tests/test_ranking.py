"""The ranking and its text functions against plain Python written from their descriptions."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspan.functions import text as T
from larkspan.operators import retrieval as R
from larkspan.plans import text as plans
from larkspan.plans.tables import chunks


def tokens(s):
    low = s.lower()
    out = re.findall(r"[a-z0-9][a-z0-9_+.#/-]*", low)
    for run in re.findall("[\u3400-\u9fff]+", low):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def hashed(s):
    v = Counter()
    for t in set(tokens(s)):
        d = hashlib.blake2b(t.encode(), digest_size=4).digest()
        v[int.from_bytes(d, "big") % 256] += 1 if d[0] % 2 else -1
    return v


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return sum(x * b[k] for k, x in a.items()) / n if n else 0.0


def brute_entities(query, families):
    """Marks the query letter by letter: longest first, then leftmost, concepts before aliases, names in order."""
    low, word = query.lower(), set("abcdefghijklmnopqrstuvwxyz0123456789_/-")
    found = []
    for kind, name, terms in families:
        for t in terms:
            t, at = t.lower(), 0
            while t and at + len(t) <= len(low):
                bounded = not set(t) - (word | set("+.#"))
                free = not bounded or (low[at - 1 : at] not in word and low[at + len(t) : at + len(t) + 1] not in word)
                if low[at : at + len(t)] == t and free:
                    found.append((-len(t), at, kind != "concept", name, kind))
                    at += len(t)
                else:
                    at += 1
    used, hit = [False] * len(low), set()
    for size, at, _, name, kind in sorted(found):
        if not any(used[at : at - size]):
            used[at : at - size] = [True] * -size
            hit.add((kind, name))
    return [(k, n) for k, n, _ in families if (k, n) in hit]


FAMILIES = [
    ("alias", "cf", ["cf", "协同过滤", "co-filter"]),
    ("alias", "filter", ["filter", "过滤"]),
    ("concept", "two-tower", ["Two Tower", "two tower", "双塔"]),
    ("alias", "tower", ["tower", "two tower", "c++"]),
    ("concept", "filtering", ["filter"]),
    ("alias", "odd", ["a\\Eb", "(x", "."]),
]


def test_entities(spark):
    rng = random.Random(6)
    bits = ["cf", "co-filter", "filter", "协同过滤", "过滤", "two", "tower", " ", "-", "双塔", "x", "C++", "a\\Eb", "(x", "Two Tower", ".", "9", "é"]
    queries = ["", None, "TWO TOWER", "cf cf", "filterfilter"] + ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(queries)), "qid int, query string")
    for r in T.resolve_entities(df, FAMILIES).collect():
        assert [(m.kind, m.family) for m in r.matches] == brute_entities(r.query or "", FAMILIES), r.query


def test_expansion_and_hints(spark):
    aliases = {"cf": ["协同过滤"], "双塔": ["dual encoder"]}
    concepts = [("two-tower", "双塔", 4), ("as-of", "As-of join", 7), ("cf-old", "cf", 2), ("cf-new", "cf", 3)]
    df = spark.createDataFrame([(1, "cf 双塔"), (2, "as of cf"), (3, "dual encoder"), (4, "none"), (5, "协同过滤"), (6, "AS-OF JOIN two tower"), (7, None)], "qid int, query string")
    expanded = {r.qid: r.expanded for r in T.expand_queries(df, aliases).collect()}
    assert expanded == {1: "cf 双塔 cf 协同过滤 双塔 dual encoder", 2: "as of cf cf 协同过滤", 3: "dual encoder 双塔", 4: "none", 5: "协同过滤 cf", 6: "AS-OF JOIN two tower", 7: ""}
    hints = {r.qid: r.chapters for r in T.chapter_hints(df, concepts, aliases).collect()}
    # 1, 2: of concepts with one title the first by id; 3: only the alias is named, and one concept has its title; 5: two have
    assert hints == {1: [3, 4], 2: [3, 7], 3: [4], 4: [], 5: [], 6: [4, 7], 7: []}


@pytest.mark.parametrize("text, value", [("十", 10), ("十九", 19), ("二十", 20), ("九十九", 99), ("零", 0), ("07", 7), ("十十", None), ("百", None), ("", None), ("99999999999", None)])
def test_chapter_number(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(T.chapter_number(F.col("t"))).first()[0] == value


def test_rank(spark, small):
    """Every score of the composite ranking, recomputed chunk by chunk."""
    q = T.chapter_hints(T.expand_queries(plans._queries(spark, small), plans.ALIASES), plans.CONCEPTS, plans.ALIASES).collect()
    docs = chunks(spark, small).collect()
    body = {c.id: f"{c.title or ''} {c.section or ''} {c.text or ''}" for c in docs}
    toks = {i: Counter(tokens(b)) for i, b in body.items()}
    size = {i: sum(t.values()) for i, t in toks.items()}
    vec = {i: hashed(b) for i, b in body.items()}
    mean, df = max(1.0, sum(size.values()) / len(docs)), Counter(t for c in toks.values() for t in c)
    got = {}
    for r in plans.q9(spark, small).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id, r.score))
    assert set(got) == {x.qid for x in q}
    for x in q:
        qt, qv, scored = tokens(x.expanded), hashed(x.expanded), []
        for c in docs:
            s = 0.0
            for t in qt:
                tf = toks[c.id][t]
                s += math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[c.id] / mean)) if tf else 0.0
            s += 3 * max(0.0, cosine(qv, vec[c.id])) + 6 * (x.query.lower() in body[c.id].lower()) + 2 * len(set(qt) & set(tokens(c.section or "")))
            s += 12 * (len(x.chapters) == 1 and x.chapters[0] == c.chapter)
            s += 20 * (x.qid % 7 == 0 and c.source == "src3.pdf" and c.page_start == x.qid % 50 + 1)
            if s > 0:
                scored.append((-s, c.id))
        want = sorted(scored)[:5]
        mine = sorted(got[x.qid])
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
        assert all(abs(m[2] + w[0]) < 2e-6 for m, w in zip(mine, want))
        assert [m[1] for m in mine] == [w[1] for w in want] or len({round(w[0], 6) for w in want}) < len(want)


def test_knn_blocks(spark):
    rng = random.Random(8)
    vecs = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(90)]
    items = spark.createDataFrame(vecs, "id long, vec array<double>").repartition(4)
    queries = items.where("id % 9 = 0").select(F.col("id").alias("qid"), "vec")

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    for block in (1, 7, 2048):
        out = {}
        for r in R.knn(queries, items, 4, block=block).collect():
            out.setdefault(r.qid, []).append((r.rank, r.id, r.sim))
        for qid, v in vecs[::9]:
            want = sorted((-cos(v, w), i) for i, w in vecs)[:4]
            assert all(abs(m[2] + w[0]) < 1e-9 for m, w in zip(sorted(out[qid]), want))
    assert R.knn(queries.limit(0), items, 4).count() == 0 and R.knn(queries, items.limit(0), 4).count() == 0


def test_code_relevance(spark):
    rows = [("a/two_tower.py", "recall"), ("b/tower-net.py", "双塔 召回"), ("c/x.py", "tower net"), ("d/net.PY", None), ("e/.hidden", "net")]
    df = spark.createDataFrame(rows, "path string, label string")
    score = lambda q: [r[0] for r in df.select(R.code_relevance(F.col("path"), F.col("label"), F.lit(q))).collect()]
    assert score("") == [1] * 5
    assert score("net") == [0, 30, 0, 30, 0]  # three letters: a whole word of the name, which the term finds again
    assert score("tower") == [30, 30, 20, 0, 0]
    assert score("双塔") == [0, 24, 0, 0, 0]
    assert score("tower net") == [2, 32, 20, 2, 0]


def test_hashed_cosine(spark, small):
    docs = {r.doc_id: hashed(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    q = {r.qid: hashed(r.query) for r in plans._queries(spark, small).collect()}
    got = {(r.qid, r.doc_id): r.sim for r in plans.hashed(spark, small).collect()}
    assert set(got) == {(i, d) for i in q for d in docs}
    assert all(abs(got[i, d] - cosine(q[i], docs[d])) < 2e-6 for i, d in got)


def test_diversify(spark):
    """Greedy: each pick has the best mix of score and distance from what is picked already."""
    from larkspan.operators import metrics

    rng = random.Random(3)
    rows = [(q, i, round(rng.random(), 3), [rng.choice([-1.0, 0.5, 1.0]) for _ in range(4)]) for q in (1, 2) for i in range(12)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    out = {(r.q, r["rank"]): r.i for r in metrics.diversify(spark.createDataFrame(rows, "q int, i int, s double, v array<double>"), "q", "i", "s", "v", 5).collect()}
    for q in (1, 2):
        left, picked = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])), []
        while len(picked) < 5:
            value = lambda r: 0.7 * r[2] - 0.3 * max((cos(r[3], p[3]) for p in picked), default=0.0)  # noqa: B023, E731
            best = max(left, key=value)
            assert abs(value(best) - value(next(r for r in left if r[1] == out[q, len(picked) + 1]))) < 1e-9
            best = next(r for r in left if r[1] == out[q, len(picked) + 1])
            left.remove(best)
            picked.append(best)


def test_negative_samples(spark):
    """Negatives come from the catalogue, are no positives, are as many as asked if the draws allow, and never change."""
    from larkspan.operators import cf

    rng = random.Random(4)
    pairs = spark.createDataFrame(sorted({(rng.randrange(12), rng.randrange(300) * 7) for _ in range(80)}), "user long, item long")
    items = spark.range(300).select((F.col("id") * 7).alias("item"))
    runs = [sorted(tuple(r) for r in cf.negative_samples(pairs.repartition(n), items, 2).collect()) for n in (1, 5)]
    seen = {tuple(r) for r in pairs.collect()}
    assert runs[0] == runs[1] and not set(runs[0]) & seen and len(set(runs[0])) == len(runs[0])
    assert {i for _, i in runs[0]} <= {7 * k for k in range(300)}
    per = Counter(u for u, _ in seen)
    assert all(n <= 2 * per[u] for u, n in Counter(u for u, _ in runs[0]).items()) and len(runs[0]) >= 1.9 * len(seen)
