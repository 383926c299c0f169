"""Queries on small tables with ids far apart, against their SQL: whole tables are read, whatever the ids."""

import duckdb
import pytest

from larkspan.plans import catalog

from .test_queries import norm


@pytest.fixture(scope="module")
def wide(tmp_path_factory, small):
    """The smallest tables, with the documents' ids 0 to 1,990 in steps of ten and benchmark items from 1,000 on."""
    d = str(tmp_path_factory.mktemp("wide"))
    duckdb.sql(f"copy (select * replace (doc_id * 10 as doc_id) from '{small}/documents.parquet') to '{d}/documents.parquet'")
    duckdb.sql(f"copy (select * replace (item_id + 1000 as item_id) from '{small}/benchmark.parquet') to '{d}/benchmark.parquet'")
    return d


NAMES = ["sc6_pack_paragraphs", "sc8_sections", "pf15_submission_diagnosis", "q2_bm25", "pf1_chapter_filter", "tk1_top_k", "tk3_evidence_pages", "ag18_retrieval_metrics", "fn_expand_queries"]


@pytest.mark.parametrize("name", NAMES)
def test_whole_tables(spark, wide, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{wide}/{t}.parquet'")
    ref = con.sql(catalog.SQL[name])
    mine = catalog.QUERIES[name](spark, wide)
    rows = lambda got, columns: sorted(tuple(norm(r[columns.index(c)]) for c in sorted(columns)) for r in got)
    assert rows(mine.collect(), mine.columns) == rows(ref.fetchall(), ref.columns)


def test_every_query_is_asked(spark, wide):
    n = spark.read.parquet(f"{wide}/benchmark.parquet").count()
    assert catalog.QUERIES["fn_hashed_cosine"](spark, wide).select("qid").distinct().count() == n > 12
    assert catalog.QUERIES["q9_rank"](spark, wide).select("qid").distinct().count() == n
