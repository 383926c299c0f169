"""Defined results where it is easy to go wrong: regular strings, repeated and null ids, clashing columns, empty tables."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from larkspan.llm import exact, jaccard, langid, mixing, packing, queries, sharding, substring, suffix, urlfilter
from larkspan.llm.common import scratch, scratch_root

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA, *more):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *more) for i, t in rows], schema).repartition(3)


def words(letter, n, start=0):
    return " ".join(f"{letter}{i}" for i in range(start, start + n))


def thue_morse(n, a="a", b="b"):
    """A string of a regular build that collides with its complement under polynomials modulo powers of two."""
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_thue_morse_words(spark):
    t, u = thue_morse(2048), thue_morse(2048, "b", "a")
    out = got(jaccard.similar_components(frame(spark, [(1, t), (2, u), (3, t)])), "doc_id", "component_id", "class_id")
    assert out == [(1, 1, 1), (2, 2, 2), (3, 1, 1)]
    head = words("w", 49)
    rows = [(1, f"{head} {t}"), (2, f"{head} {u}"), (3, f"{head} {t}")]
    assert got(substring.substring_dedup(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(rows)


def test_thue_morse_bytes(spark):
    t, u = thue_morse(1024), thue_morse(1024, "b", "a")
    rows = [(1, "x" * 500 + t), (2, u + "y"), (3, t[:600]), (4, u[5:700]), (5, thue_morse(512, "ab", "ba"))]
    assert got(suffix.suffix_dedup(frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix(rows), key=repr)


#: Ids that stand with several texts, and rows without an id.
LONG = words("p", 300)
MIXED = [(1, words("a", 90) + " " + LONG), (1, words("b", 20)), (2, LONG + " " + words("c", 60)), (None, LONG), (None, words("d", 80)), (2, words("b", 20)), (None, None), (3, words("d", 80)), (3, words("d", 80))]


@pytest.mark.parametrize("cap", [400, 2])
def test_suffix_rows(spark, cap):
    """Rows are documents: those that share an id, or have none, are searched and cut as themselves."""
    out = suffix.suffix_dedup(frame(spark, MIXED), window=100, cap=cap)
    want = [w for w in brute.suffix([(-9 if i is None else i, t) for i, t in MIXED], 100)]
    want = sorted([(None if i == -9 else i, *r) for i, *r in want], key=repr)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_substring_rows(spark):
    """Rows of one id are one document, each cut as itself; rows without an id are neither searched nor cut."""
    rows = MIXED + [(9, words("d", 80)), (9, "z " + words("b", 20)), (0, "")]
    out = got(substring.substring_dedup(frame(spark, rows), window=10, batches=3, fan_out=1), "doc_id", "n_words", "n_removed", "kept_sha256")
    known = [(i, t) for i, t in rows if i is not None]
    want = brute.substring(known, 10)
    alone = [brute.substring([(0, t)], 10)[0][1:] for i, t in rows if i is None]
    assert out == sorted([*want, *((None, *r) for r in alone)], key=repr)


def test_jaccard_rows(spark):
    """An id is one vertex with all its texts' links; a row without an id takes the smallest id that it reaches."""
    near = words("a", 89) + " zz " + LONG
    rows = MIXED + [(7, near), (8, words("d", 79)), (None, words("q", 30)), (None, words("q", 30)), (None, words("q", 29))]
    out = got(jaccard.similar_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    # 1 and 2 share a text; 7 is near 1; 3 and 8 are near one text without an id, 2 is near another
    want = {1: 1, 2: 1, 7: 1, 3: 3, 8: 3}
    assert all(c == want[i] for i, _, c in out if i is not None)
    none = sorted((n, c) for i, n, c in out if i is None and c is not None)
    assert none == [(76, 3), (296, 1)] and sum(i is None for i, _, _ in out) == 6
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(frame(spark, rows)).collect()]
    assert sorted(i for i, _ in kept if i is not None) == [1, 1, 3, 3]
    assert sorted(t or "" for i, t in kept if i is None) in (["", words("q", 29)], ["", words("q", 30)])


def test_jaccard_blocks_and_families(spark):
    """Families of near copies of every size, with what stands just outside, in large buckets and small blocks."""
    import random

    rng = random.Random(11)
    rows = []
    for f, size in enumerate((2, 9, 30, 70)):
        base = [f"f{f}_{i}" for i in range(90)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                w[rng.randrange(90)] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w[: rng.choice([90, 90, 90, 75])])))
    line = words("l", 30)
    rows += [(1000 + i, f"{line} {words(f'u{i}_', 40)}") for i in range(40)]
    want = brute.jaccard(rows)
    for options in ({}, {"frequent": 5}, {"frequent": 5, "small": 2, "block": 500}, {"frequent": 10**9, "small": 3, "block": 300}):
        assert got(jaccard.similar_components(frame(spark, rows), **options), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr), options


def test_refuted_halves(spark, monkeypatch):
    """Links that half hashes invent are refuted on the texts, and what they may have hidden is tried again."""
    real = jaccard._joining_links

    def eager(ids, n, comp, outside, inside, flat, start, similar, all_links):
        if all_links:
            return real(ids, n, comp, outside, inside, flat, start, similar, True)
        return [(ids[outside[0]], ids[y]) for y in inside if comp[y] != comp[outside[0]]][:1]

    monkeypatch.setattr(jaccard, "_joining_links", eager)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:60] + [f"q{i // 2}_{j}" for j in range(40)] + ([f"e{i}"] if i % 2 else []))) for i in range(30)]
    out = jaccard.similar_components(frame(spark, rows), frequent=4, small=2)
    assert got(out, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(rows), key=repr)


def test_keep_first_rows(spark):
    """One row of each group of equal texts stays, one with the smallest id if there is an id at all."""
    rows = [(5, "a  b"), (3, "a b"), (3, "other"), (None, "a\tb"), (None, "only here"), (None, "only  here"), (4, "other"), (None, None), (6, " "), (3, "a b"), (8, "x")]
    kept = [(r.doc_id, r.text) for r in exact.keep_first(frame(spark, rows)).collect()]
    assert sorted(kept, key=repr)[0][0] in (3, 8) and len(kept) == 6
    assert {i for i, t in kept if t and t.split() == ["a", "b"]} == {3} and {i for i, t in kept if t == "other"} == {3}
    assert {i for i, t in kept if t and t.split() == ["only", "here"]} == {None}
    assert {i for i, t in kept if not t} == {None} and {i for i, t in kept if t == " "} == {6} and (8, "x") in kept


def test_keep_first_blank(spark):
    """A blank is one space and an empty text none, so they are two groups; a null text is an empty one."""
    kept = [(r.doc_id, r.text) for r in exact.keep_first(frame(spark, [(1, None), (2, ""), (3, " "), (4, "\n\t")])).collect()]
    assert sorted(kept) == [(1, None), (3, " ")]


def test_index_files_go(spark):
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    exact.exact_dedup(frame(spark, [(1, "a"), (2, "a")])).collect()
    substring.substring_dedup(frame(spark, [(1, LONG), (2, LONG)])).collect()
    with pytest.raises(Exception, match="boom"):
        bad = frame(spark, [(1, LONG), (2, LONG)]).withColumn("text", F.when(F.col("doc_id") == 2, F.raise_error(F.lit("boom"))).otherwise(F.col("text")))
        substring.substring_dedup(bad).collect()
    left = {x.split("-")[0] for x in set(os.listdir(root)) - before}
    assert "run" not in left and "digest" not in left
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("digest_index", "fingerprint_run"))]


def test_known_columns_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumns({"score": F.lit(777.0), "lang_pred": F.lit("mine"), "_text": F.lit(1), "_score": F.lit(2)})
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() > 100
    assert kept.select("score", "lang_pred", "_text", "_score").distinct().collect() == [(777.0, "mine", 1, 2)]


#: Names that the operators use themselves.
CLASHING = "_row string, _hash string, _doc string, _taken string, row string, n string, digest string, keep_id string, component_id string, size string, shard string, slot string, score string, lang_pred string, h1 string, tokens string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeats and a long text, with columns whose names clash."""
    names = CLASHING.count(",") + 1
    english = "the quick brown fox jumps over the lazy dog and then the fox is seen by all of us in the old wood "
    long = " ".join(english + str(i) for i in range(1500))
    rows = [(1, english * 3), (1, english * 3), (None, english * 3), (2, None), (None, None), (3, ""), (4, " \n"), (5, long), (6, long), (7, "der schnelle Fuchs und die Katze sind nicht im Haus, das ist auch gut so " * 3), (8, "123 456")]
    labelled = [(100 + i, english + " ".join(f"word{j * i}" for j in range(20))) for i in range(30)]
    full = [(i, t, "en" if i != 7 else "de", None if i == 8 else f"s{(i or 0) % 2}", len(t or ""), *["x"] * names) for i, t in rows + labelled]
    return spark.createDataFrame(full, f"{SCHEMA}, {CLASHING}").repartition(3)


def test_stages_on_odd_rows(spark, odd):
    """Every stage keeps all columns as they are and gives each case its stated result."""
    columns, extra = odd.columns, [c.split()[0] for c in CLASHING.split(", ")]
    stages = dict(P.STAGES)
    outs = {name: stages[name](spark, odd, "").cache() for name in stages}
    for name in ("language_id", "exact_dedup", "ngram_jaccard", "mix_sources"):
        assert outs[name].columns == columns
        assert {tuple(r) for r in outs[name].select(*extra).distinct().collect()} == {tuple("x" for _ in extra)}, name
    known = outs["language_id"]
    assert known.where("text is null or trim(text) = '' or doc_id in (3, 4, 8)").count() == 0 and known.where("doc_id = 1").count() == 2
    first = outs["exact_dedup"].collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in first if r.doc_id is None or r.doc_id < 100) == [(False, i) for i in (1, 2, 4, 5, 7, 8)]
    one = outs["ngram_jaccard"].collect()
    # rows that repeat an id stay together; nulls and blanks have no shingles and stay
    assert sorted(r.doc_id or 0 for r in one if (r.doc_id or 0) < 100) == [0, 1, 1, 2, 3, 4, 5, 7, 8]
    mixed = outs["mix_sources"].collect()
    assert all(r.text and r.n_chars == len(r.text) for r in mixed) and {r.doc_id for r in mixed} >= {1, 5, 7}
    packed = outs["pack"].collect()
    words_of = lambda rows: sum(len(brute.words(t)) for t in rows)
    assert sum(r.n_words for r in packed) == words_of(r.text for r in odd.collect())
    assert sum(r.seq_id is None for r in packed) == 4


def test_stages_on_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in P.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0 and (name == "pack" or out.columns == empty.columns), name
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.url_filter(pages, queries.URL_RULES).count() == 0


def test_packing_repeats(spark):
    """Copies are packed one by one, the same way in every run."""
    rows = [(1, words("a", 40))] * 50 + [(None, words("b", 7))] * 3 + [(2, None), (2, words("c", 300))]
    runs = [got(packing.pack_documents(frame(spark, rows).repartition(n), lengths=(64, 256), group=20), "doc_id", "piece", "n_words", "seq_id", "seq_offset") for n in (2, 5)]
    assert runs[0] == runs[1] and sum(r[2] for r in runs[0]) == 50 * 40 + 3 * 7 + 300
    assert len({r[3] for r in runs[0] if r[0] == 1}) >= 50 // 6


def test_sharding_nulls(spark):
    """A large group of equal rows without an id is split like any other."""
    out = sharding.shard_documents(frame(spark, [(None, words("a", 30))] * 3000 + [(i, words("b", 5 + i % 9)) for i in range(200)])).collect()
    load = [sum(r["size"] for r in out if r.shard == s) for s in range(8)]
    assert max(load) - min(load) <= 300 and all(sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out))) for s in range(8))


def test_scratch_without_settings(tmp_path):
    """A local session without any preset configuration can run an operator that settles tables."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = (
        "from pyspark.sql import SparkSession; from larkspan.llm import packing; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate();"
        "assert packing.pack_documents(s.createDataFrame([(1, 'a b c')], 'doc_id long, text string')).count() == 1"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": root, "SPARK_CONF_DIR": str(tmp_path)})


def test_scratch_is_shared(spark):
    assert scratch(spark, "x").startswith(scratch_root(spark) + "/x-")


def test_mixed_repeated_null(spark):
    """A null text under an id that also has words gives and takes nothing."""
    rows = [(1, None), (1, words("a", 30)), (2, "")]
    out = mixing.mixed_documents(frame(spark, rows), block=8).collect()
    assert {r.doc_id for r in out} == {1} and all(r.text for r in out)
