"""Every registered query with SQL gives the rows of its SQL in DuckDB."""

import os

import pytest

from strandflow.plans import catalog
from tests.oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    assert name in catalog.ORACLES
    assert compare(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], SF_DIR, con) == ""


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 7 and {"genic", "sub_genic", "legacy_cds"} <= {r["name"] for r in rows}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
