"""Every registered query against its SQL oracle; those without one must run and give rows."""

import os

import pytest

from compare import compare, connect
from hydrospark.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        ok, message = compare(name, df, con, ORACLES[name])
        assert ok, message
    else:
        assert len(df.take(1)) == 1
