"""Every query of the training-data part runs at the smallest scale and equals its SQL where it has some."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from gradloom.llm import oracle, queries  # noqa: E402
from test_queries import SF, compare  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_equals_sql(spark, name):
    compare(spark, name)


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - oracle.ORACLE.keys()))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0
