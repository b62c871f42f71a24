"""Every core query against its oracle SQL, over the smallest tables."""

import os

import duckdb
import pytest

from seqframe import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(v[i], 9) if isinstance(v[i], float) else v[i] for i in order)) for v in values)


def compare(spark, name, query, sql):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = query(spark, SF)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, name):
    compare(spark, name, Q.QUERIES[name], Q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_without_oracle(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry_imports_without_the_optional_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['seqframe.llm'] = None; import __spark_entry__ as e; assert e.llm is None and set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
