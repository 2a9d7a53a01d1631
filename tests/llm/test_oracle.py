"""Corpus queries that SQL can state give the rows of their SQL."""

import os

import pytest

from strandflow.llm.oracles import ORACLE_SQL
from strandflow.llm.queries import QUERIES
from tests.oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLE_SQL[name], SF_DIR, connect(SF_DIR)) == ""


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
