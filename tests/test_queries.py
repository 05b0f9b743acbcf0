"""Registered queries against their oracles on the smallest tables; streams against batches."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from leadloom.plans import registry
from tests.conftest import SF

QUERIES, ORACLES = registry.collect()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(records):
    return sorted(tuple("NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, (int, float)) else str(v) for v in r) for r in records)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = [[r[c] for c in names] for r in df.collect()]
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert rows(found) == rows([[r[k] for k in order] for r in result.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_without_llm(tmp_path, with_pipeline):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/leadloom", tmp_path / "leadloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", "corpus_pipeline.py"][: 1 + (with_pipeline and os.path.exists(f"{root}/corpus_pipeline.py"))]:
        shutil.copy(f"{root}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_plans_have_no_cartesian_product(spark):
    for name in ("d4_fuzzy_match", "d11_find_existing", "d16_near_codes", "k4_similar_items"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
