"""Every query of the catalogue against its SQL, in DuckDB over the same files."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quillon import queries as Q

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    if name not in Q.oracle_sql():
        assert rows
        return
    relation = duck.sql(Q.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    assert rows == sorted((tuple(r) for r in relation.select(*columns).fetchall()), key=repr)


def test_the_library_stands_without_the_training_data_part():
    """The driver contract without quillon.llm and corpus_pipeline."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('quillon.llm', 'corpus_pipeline'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'flagship' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
        "assert not [m for m in sys.modules if m.startswith('quillon.llm')]\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)


def test_filters_reach_the_scan(spark):
    df = Q.queries()["and_multi"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(o_orderstatus,F)" in plan and "EqualTo(c_mktsegment,BUILDING)" in plan and "LeftSemi" in plan
