import subprocess
import sys

import pytest

from framewise.catalog import QUERIES, SQL
from tests.compare import rows, sql_rows
from tests.conftest import ROOT


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), sql_rows(small, SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_queries_are_readable_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
