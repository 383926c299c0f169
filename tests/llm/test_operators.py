"""Each operator against brute force on small tables with nulls, blanks, ties, repeats and long texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import components, exact, jaccard, langid, mixing, packing, quality, queries, sharding, substring, suffix, urlfilter
from larkspan.session import table

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Random texts with exact copies, near copies, shared passages, self-repeats, blanks and nulls."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["Été", "naïve", "日本", "x" * 90]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = text(130)
    out = []
    for i in range(n):
        kind = i % 10
        if kind < 4 or not out:
            t = text(rng.choice([1, 3, 5, 30, 200, 400]))
        elif kind == 4:
            t = rng.choice(out) or ""
        elif kind in (5, 6):
            w = (rng.choice(out) or "").split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        elif kind == 7:
            t = f"{text(rng.randint(0, 40))}\n{passage}\t{text(rng.randint(0, 40))}"
        elif kind == 8:
            t = "\n".join([text(70)] * 3)
        else:
            t = rng.choice([None, "", " \n\t ", "A b C d", "a B c D", text(3000)])
        out.append(t)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


def frame(spark, rows):
    full = [(i, t, ["en", "fr", None][k % 3], f"src{k % 4}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("cap", [400, 2])
def test_suffix(docs, rows, cap):
    assert got(suffix.suffix_dedup(docs, cap=cap), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix(rows)


def test_suffix_periodic(spark):
    rows = [(1, "ab" * 400), (2, "x" * 399), (3, "y" * 401), (4, None), (5, "ab" * 199 + "a"), (6, "é" * 300)]
    assert got(suffix.suffix_dedup(frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix(rows)


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(200):
        s = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode() for _ in range(rng.randint(1, 30))]
        for shallow in (0, 2, 8):
            order = suffix.deep_shallow(s, shallow)
            assert sorted(order) == list(range(len(s))) and [s[i] for i in order] == sorted(s)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substring(docs, rows, batches):
    out = substring.substring_dedup(docs, batches=batches, fan_out=2)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(rows)


@pytest.mark.parametrize("options", [{}, {"frequent": 2, "small": 2}, {"frequent": 2, "small": 2, "block": 40}, {"frequent": 10**9, "small": 2}])
def test_jaccard(docs, rows, options):
    assert got(jaccard.similar_components(docs, **options), "doc_id", "n_shingles", "component_id") == brute.jaccard(rows)


def test_jaccard_group(spark):
    """Many near copies that all share frequent tokens, and documents that share a passage but are not similar."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:40] + [f"q{i}_{j}" for j in range(8)])) for i in range(60)]
    out = jaccard.similar_components(frame(spark, rows), frequent=4, small=3)
    assert got(out, "doc_id", "n_shingles", "component_id") == brute.jaccard(rows)


def test_keep_one(docs, rows):
    kept = {r.doc_id for r in jaccard.keep_one(docs).select("doc_id").collect()}
    assert kept == {i for i, _, c in brute.jaccard(rows) if i == c}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    out = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.component_id for r in out.collect()} == {x: find(x) for p in links if p[0] != p[1] for x in p}


def test_exact(docs, rows):
    import hashlib
    import re

    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    want = sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items())
    for batches in (1, 2, 3):
        out = exact.exact_dedup(docs, batches=batches).withColumn("sha", F.lower(F.hex("digest")))
        assert got(out, "doc_id", "keep_id", "group_size", "kept", "sha") == want
    kept = {r.doc_id for r in exact.keep_first(docs).select("doc_id").collect()}
    assert kept == {w[0] for w in want if w[3]}


def test_exact_index_persists(spark, tmp_path):
    index = exact.DigestIndex(spark, "idx_test", str(tmp_path / "idx"), 4)
    first = exact.digests(frame(spark, [(5, "a b"), (7, "c")]))
    exact.dedup_batch(first, index).collect()
    spark.sql("DROP TABLE idx_test")
    index = exact.DigestIndex(spark, "idx_test", str(tmp_path / "idx"), 4)
    second = exact.dedup_batch(exact.digests(frame(spark, [(1, "a  b"), (2, "new"), (9, "new")])), index)
    assert got(second, "doc_id", "keep_id", "kept") == [(1, 5, False), (2, 2, True), (9, 2, False)]
    index.drop()


def test_sharding(docs, rows):
    out = sharding.shard_documents(docs).collect()
    sizes = {i: len((t or "").encode()) + 1 for i, t in rows}
    assert {r.doc_id: r["size"] for r in out} == sizes
    assert {r.doc_id: r.text_crc32 for r in out} == {i: zlib.crc32((t or "").encode()) for i, t in rows}
    load = [0] * 8
    for s in range(8):
        here = [r for r in out if r.shard == s]
        load[s] = sum(r["size"] for r in here)
        assert sorted(r.slot for r in here) == list(range(len(here)))
    assert max(load) - min(load) <= 2 * max(sizes.values())


def test_sharding_hot_group(spark):
    rows = [(i, "same text " * 20 if i % 2 else f"text {i}" * 30) for i in range(4000)]
    load = {}
    for r in sharding.shard_documents(frame(spark, rows)).collect():
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 1000


def test_url_filter(spark):
    urls = ["http://Example.COM/en/x", "https://www.example.com/en/", "http://a.net/es/?q", "http://a.net/es", "http://net/fr/z#t", "x.com/", None, "", "ftp://com", "http://com/", "http://xcom/", "http://com?x/", "http://b.www.example.com/en/1", "http://example.com/english/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    host = ["example.com", "www.example.com", "a.net", "a.net", "net", "", "", "", "com", "com", "xcom", "com", "b.www.example.com", "example.com"]
    path = ["/en/x", "/en/", "/es/", "/es", "/fr/z", "", "", "", "", "/", "/", "", "/en/1", "/english/"]
    rule = ["example.com/en/", "www.example.com/en/", "net/es/", None, "net/fr/", None, None, None, None, "com/", None, None, "www.example.com/en/", "com/"]
    verdict = ["block", "allow", "block", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow"]
    want = list(zip(range(len(urls)), host, path, rule, verdict))
    for rules, limit in ((queries.URL_RULES, 100), (queries.URL_RULES, 0), (spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string"), 100)):
        out = urlfilter.url_filter(pages, rules, limit=limit).select("page_id", "host", "path", "rule", "verdict")
        assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[0]) == want


def test_url_trie_random():
    rng = random.Random(4)
    labels, segs = ["a", "b", "c"], ["", "x", "xy", "z"]
    for _ in range(300):
        rules = [(".".join(rng.choices(labels, k=rng.randint(1, 3))), "/" + "/".join(rng.choices(segs, k=rng.randint(1, 3))), rng.choice(["allow", "block"])) for _ in range(6)]
        host, path = ".".join(rng.choices(labels, k=rng.randint(1, 4))), "/" + "/".join(rng.choices(segs, k=rng.randint(1, 4)))
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (r[0].count("."), len(r[1]), r[2])) if fits else None
        found = urlfilter.longest(urlfilter.build_trie(rules), host, path)
        assert found == ((best[0] + best[1], best[2]) if best else None)


def test_quality(docs, rows):
    out = quality.quality(docs)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(out, *columns) == sorted((i, *brute.quality(t)) for i, t in rows)
    assert all(not (r.base_failed and r.kept) for r in out.select("base_failed", "kept").collect())


def test_quality_symbols_and_lines(spark):
    t = "#one *two $3 %4 &five |six <seven> 8\n\n  \nsame line\nsame line\n same line\nsame line\n" + " ".join(f"word{i}" for i in range(30))
    rows = [(1, t), (2, t + "\n" + t), (3, None)]
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(quality.quality(frame(spark, rows)), *columns) == sorted((i, *brute.quality(x)) for i, x in rows)


def test_language(spark, small):
    docs = table(spark, small, "documents")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    extra = spark.createDataFrame([(9001, None, "en"), (9002, "12 34 --", "en"), (9003, "", None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(extra)
    assert {r.lang_pred for r in langid.identify(both).where("doc_id > 9000").collect()} == {"und"}


def test_language_ignores_labels_of_held_out(spark, small):
    docs = table(spark, small, "documents")
    wrong = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert got(langid.identify(docs), "doc_id", "lang_pred", "score") == got(langid.identify(wrong), "doc_id", "lang_pred", "score")


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        keys = mixing._round_keys(1, 2, 3)
        p = mixing.permute(np.arange(n), n, keys)
        assert sorted(p) == list(range(n))
        assert list(mixing.permute(p, n, keys, back=True)) == list(range(n))


@pytest.mark.parametrize("block", [1, 7, 512])
def test_mixing(docs, rows, block):
    out = mixing.mix_report(docs, block=block)
    again = got(mixing.mix_report(docs.repartition(5), block=block), "doc_id", "taken")
    assert got(out, "doc_id", "taken") == again
    rows_ = out.join(docs.select("doc_id", "source"), "doc_id").collect()
    size = {i: len(brute.words(t)) for i, t in rows}
    assert {r.doc_id: r["size"] for r in rows_} == size
    goal = mixing.targets({s: sum(r["size"] for r in rows_ if r.source == s) for s in {r.source for r in rows_}})
    for s, t in goal.items():
        mine = [r for r in rows_ if r.source == s]
        assert abs(sum(r.taken for r in mine) - t) <= 0.5 and all(r.taken <= 2 * r["size"] and abs(r.target - t) < 1e-6 for r in mine)


def test_targets():
    t = mixing.targets({"b": 100, "a": 10, None: 5, "c": 1000})
    assert t["a"] == 20 and t[None] <= 10 and abs(sum(t.values()) - 1.5 * 1115) < 1e-6
    assert list(mixing.targets({None: 1, "é": 1, "z": 1})) != [] and mixing.targets({}) == {}


def test_mixed_documents(docs, rows):
    out = mixing.mixed_documents(docs, block=16)
    assert out.columns == docs.columns
    taken = {}
    text = dict(rows)
    for r in out.collect():
        w = brute.words(r.text)
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(w)
        assert r.n_chars == len(r.text) and set(w) <= set(brute.words(text[r.doc_id]))
    assert taken == {r.doc_id: r.taken for r in mixing.mix_report(docs, block=16).collect() if r.taken}


def test_packing(docs, rows):
    out = packing.pack_documents(docs, lengths=(16, 64, 256), group=50).collect()
    size = {i: len(brute.words(t)) for i, t in rows}
    seqs, pieces = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        if r.seq_id is not None:
            seqs.setdefault(r.seq_id, []).append(r)
    for i, n in size.items():
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert sum(r.n_words for r in mine) == n and [r.first_word for r in mine] == [256 * k for k in range(len(mine))]
        assert (n == 0) == (mine[0].seq_id is None)
    for held in seqs.values():
        held.sort(key=lambda r: r.seq_offset)
        at = 0
        for r in held:
            assert r.seq_offset == at
            at += r.n_words
        assert at == held[0].seq_used and held[0].seq_length == min(c for c in (16, 64, 256) if c >= at)


def test_pack_best_fit():
    bins, offsets, lengths = packing.pack(np.array([60, 30, 30, 4, 4, 4]), (64, 128))
    assert sum(lengths) >= 132 and len(set(zip(bins, offsets))) == 6
    assert packing.pack(np.zeros(0, dtype=np.int64), (64,))[2] == []


def test_empty(empty):
    assert suffix.suffix_dedup(empty).count() == 0
    assert substring.substring_dedup(empty).count() == 0
    assert jaccard.similar_components(empty).count() == 0
    assert exact.exact_dedup(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert quality.quality(empty).count() == 0
    assert langid.identify(empty).count() == 0
    assert mixing.mix_report(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0


def test_null_ids_and_repeats(spark):
    t = " ".join(f"w{i}" for i in range(200))
    rows = [(None, t), (1, t), (1, t), (2, None), (None, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", 1, "clash", "clash") for i, x in rows], SCHEMA + ", h1 string, n string")
    assert suffix.suffix_dedup(docs).count() == 5
    assert substring.substring_dedup(docs).count() == 5
    out = jaccard.similar_components(docs).collect()
    assert len(out) == 5 and {r.component_id for r in out if r.doc_id == 1} == {1}
    assert exact.exact_dedup(docs).count() == 5
    assert sorted((r.shard, r.slot) for r in sharding.shard_documents(docs).collect()) == sorted(set((r.shard, r.slot) for r in sharding.shard_documents(docs).collect()))
    assert quality.quality(docs).count() == 5
    assert langid.identify(docs).count() == 5
    assert packing.pack_documents(docs).select("doc_id").count() == 5
    assert mixing.mix_report(docs).count() == 3  # ids are documents here
