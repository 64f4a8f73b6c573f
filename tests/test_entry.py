import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_import_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent).returncode == 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["event_type", "n", "mean", "verdict"] and out.count() == 5


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return repr(float(v)) if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [k for k in entry.oracle_sql() if k in entry.catalogue.queries()])
def test_query_equals_its_sql(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    sql = tables.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    order = [sql.columns.index(c) for c in columns]
    want = sorted(tuple(cell(r[i]) for i in order) for r in sql.fetchall())
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == want
