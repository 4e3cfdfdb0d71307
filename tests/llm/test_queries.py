import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from ledgerlens.llm.catalog import ORACLE, QUERIES
from tests.conftest import ROOT, SF01

TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    return sorted(frame[sorted(frame.columns)].itertuples(index=False, name=None), key=str)


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF01}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, SF01).toPandas(), db.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_entry_works_without_the_subpackage(scratch):
    """With this subpackage and the pipeline module left out, the other queries are still there."""
    keep = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(os.path.join(ROOT, "ledgerlens"), f"{scratch}/ledgerlens", ignore=keep)
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), scratch)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=scratch, env=env, capture_output=True, text=True, check=True)
    n, found, sql = out.stdout.split()
    assert int(n) >= 40 and found == "False" and int(sql) >= 40
