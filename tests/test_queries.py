"""Every query runs at the smallest scale and equals its SQL where it has some; the rest of the library doesn't need the training-data part."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from gradloom import diff_queries, oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(names, table):
    def value(v):
        return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v

    order = sorted(names)
    return sorted((tuple(value(r[names.index(c)]) for c in order) for r in table), key=repr)


def compare(spark, name):
    """Assert that a query's rows are those of its SQL at the smallest scale."""
    got = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in os.listdir(SF):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted({**oracle.ORACLE, **diff_queries.ORACLE}))
def test_equals_sql(spark, name):
    compare(spark, name)


def test_every_query_without_sql_runs(spark):
    for name in sorted(entry.queries().keys() - entry.oracle_sql().keys()):
        if not name.startswith("p"):
            assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_library_without_the_training_data_part():
    code = "import sys; sys.modules['gradloom.llm'] = None; import __spark_entry__ as e; assert 'ppl_by_lang' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))
