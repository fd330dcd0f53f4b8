"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import oracle
from strandframe.plans.catalog import load

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQLS = load()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQLS:
        assert oracle.compare(df, con, SQLS[name]) is None
    else:
        assert df.count() >= 0
