"""Mixing takes rows for documents: null ids, and ids that stand with several texts, lose nothing."""

import pytest

from larkspan.llm import mixing

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(letter, n):
    return " ".join(f"{letter}{i}" for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    t = words("a", 30)
    rows = [(None, t, "s"), (None, words("b", 20), "s"), (1, words("c", 40), "s"), (1, words("d", 5), "s"), (1, words("e", 17), "t"), (2, t, "t"), (2, t, "t"), (3, None, "t"), (None, None, None)]
    return spark.createDataFrame([(i, x, "en", s, len(x or "")) for i, x, s in rows], SCHEMA).repartition(3)


def test_every_row_is_reported(docs):
    out = mixing.mix_rows(docs, block=8).collect()
    key = lambda i, n: (i is not None, i or 0, n)
    assert sorted(key(r.doc_id, r["size"]) for r in out) == sorted(key(r.doc_id, len(brute.words(r.text))) for r in docs.collect())
    assert {r.source_size for r in out if r["size"]} == {95, 77}
    assert all(r.taken > 0 for r in out if r["size"] and r.target >= r.source_size)
    again = mixing.mix_rows(docs.repartition(5), block=8).collect()
    assert sorted(key(r.doc_id, r.taken) for r in out) == sorted(key(r.doc_id, r.taken) for r in again)


def test_every_row_is_kept(docs):
    sizes = {(r.doc_id, r["size"]): r.taken for r in mixing.mix_rows(docs, block=8).collect()}
    out = mixing.mixed_documents(docs, block=8).collect()
    assert None in {r.doc_id for r in out} and {r.text[0] for r in out if r.doc_id == 1} == {"c", "d", "e"}
    for i, n, letter in [(None, 30, "a"), (None, 20, "b"), (1, 40, "c"), (1, 5, "d"), (1, 17, "e")]:
        mine = [brute.words(r.text) for r in out if r.doc_id == i and r.text[0] == letter]
        assert sum(map(len, mine)) == sizes[i, n] and {w for m in mine for w in m} <= set(brute.words(words(letter, n)))
