"""Registered queries beside their SQL twins on the smallest data set.

The headline queries run by default; TEST_ALL_QUERIES=1 runs every one (six minutes).
"""

import os

import pytest

import __spark_entry__ as entry
from bench import HEADLINE
from tools.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = list(entry.queries()) if os.environ.get("TEST_ALL_QUERIES") else HEADLINE
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no bench data here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, text = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
