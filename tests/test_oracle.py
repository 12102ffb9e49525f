"""Every registered query against its SQL text on the smallest data set."""

import os

import pytest

from tests.harness import compare, connect
from veil.plans.registry import callable_for, load

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ENTRIES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, con, name):
    entry = ENTRIES[name]
    df = callable_for(entry)(spark, SF)
    if entry.oracle:
        compare(df, con, entry.oracle)
    else:
        assert entry.why_rows_only
        assert df.count() > 0
