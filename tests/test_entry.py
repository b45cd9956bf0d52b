"""The driver contract in copies of the repository that lack the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q), any(k[2:3].isdigit() or k == 'pipeline' for k in q))"


@pytest.mark.parametrize("keep_pipeline", [True, False])
def test_entry_without_the_corpus_operators(tmp_path, keep_pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(TOP, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.parquet"))
    if not keep_pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    from tallyframe.plans import queries

    assert out == [str(len(queries.queries())), "True", "False"]
