"""Every registered query with a SQL twin against DuckDB, on the smallest driver tables."""

from __future__ import annotations

import ast
import os
import shutil
import subprocess
import sys

import pytest

from judgealign.plans import catalog
from tests import oracle

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.toPandas()
    assert len(set(df.columns)) == len(df.columns)
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    con = oracle.connect(SF)
    assert oracle.schema_note(df, con, catalog.ORACLES[name]) is None
    assert oracle.compare(got, con.execute(catalog.ORACLES[name]).df()) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", [["judgealign/llm", "tests/llm"], ["judgealign/llm", "tests/llm", "corpus_pipeline.py"], []])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    """A copy without the subpackage (and with or without the pipeline module) still lists every other query."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    left_out = [os.path.join(root, g) for g in gone]

    def skipped(folder, names):
        return [n for n in names if n in (".git", "__pycache__") or os.path.join(folder, n) in left_out]

    copy = shutil.copytree(root, tmp_path / "copy", ignore=skipped)
    code = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    ran = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    listed = ast.literal_eval(ran.stdout)
    assert set(catalog.QUERIES) <= set(listed)
    if gone:
        assert set(listed) == set(catalog.QUERIES)
