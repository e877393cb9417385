"""Every registered query on the smallest tables, against its SQL where it has one."""

import os

import pytest
from oracle import compare

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in CHECKS:
        assert compare(df, CHECKS[name], SF_DIR) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "n1", "n2", "statistic", "p_value"]
