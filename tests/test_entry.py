"""The registered queries against their SQL on the smallest tables."""

import importlib.util
import math
import os

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]


@needs_tables
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    want = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in order]) for r in rows) == want
