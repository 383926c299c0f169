"""The pipeline's stages, each on its predecessor's rows, and the driver's entry with and without the subpackage."""

import subprocess
import sys

import corpus_pipeline as P
from larkspan.llm import exact, jaccard
from larkspan.llm.common import settle
from larkspan.session import table

from . import brute


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    columns = docs.columns
    kept = docs
    for name, stage in P.STAGES:
        before = kept
        kept = settle(stage(spark, before, small), name)
        if name != "pack":
            assert kept.columns == columns
        if name == "ngram_jaccard":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in kept.collect()} == {i for i, _, c in brute.jaccard(rows) if i == c}
        if name == "exact_dedup":
            ids = {r.doc_id for r in exact.exact_dedup(before).where("kept").collect()}
            assert {r.doc_id for r in kept.collect()} == ids
    assert P.run(spark, small).count() == kept.count()
    assert jaccard.SIMILAR == 80 and len(P.STAGES) == 5


def test_entry_lists_everything():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert set(e.oracle_sql()) <= names


def test_entry_without_llm(tmp_path):
    """With the llm folders and the pipeline gone the entry still imports."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(os.path.join(root, "larkspan"), tmp_path / "larkspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
