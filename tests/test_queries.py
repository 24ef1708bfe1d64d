import os

import pytest

import oracle
from threadloom.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    got_columns, got = oracle.spark_rows(registry.queries()[name](spark, SF_DIR))
    want_columns, want = oracle.sql_rows(duck, registry.oracle_sql()[name])
    assert got_columns == want_columns
    missing, extra = want - got, got - want
    assert not missing and not extra, (sum(missing.values()), sum(extra.values()), list(missing)[:3], list(extra)[:3])
    assert sum(got.values()) > 0
