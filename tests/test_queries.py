"""Every query against its SQL, on the smallest of the given tables."""

import os

import pytest

import __spark_entry__ as entry
from workload.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    oracle = entry.oracle_sql().get(name)
    if oracle is None:
        assert df.count() >= 0
    else:
        assert differences(df, con, oracle) == []


def test_entry(spark):
    assert entry.entry(spark).columns == ["section", "label", "value"]
