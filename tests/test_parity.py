"""Registered queries against their SQL twins on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tamiz import queries as core

from .parity import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    import os

    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_twin(spark, con, name):
    ok, what = compare(spark, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name], con)
    assert ok, what


def test_every_twin_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["query_id", "rank"]
