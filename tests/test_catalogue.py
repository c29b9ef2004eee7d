"""Every query of the tree engine against its SQL in DuckDB, and the entry points without the optional folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from cladeflow.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_each_query_has_sql():
    assert catalogue.QUERIES.keys() == catalogue.ORACLES.keys()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_against_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = db.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    mine = sorted((tuple(clean(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(clean(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=repr) and mine


@pytest.mark.parametrize("leftovers", [False, True])
def test_entry_without_the_optional_folders(tmp_path, leftovers):
    """What is left after both folders have gone imports, and offers the queries of the tree engine."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    if leftovers:
        (copy / "cladeflow" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; from cladeflow.plans import catalogue as c; assert e.queries().keys() == c.QUERIES.keys() and e.oracle_sql() == c.ORACLES; print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("fine"), done.stderr
