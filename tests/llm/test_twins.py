"""Registered queries of this subpackage against their SQL twins on the smallest tables."""

import os

import pytest

from tamiz.llm import queries

from ..parity import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, con, name):
    ok, what = compare(spark, FOLDER, name, queries.QUERIES[name], queries.ORACLES[name], con)
    assert ok, what
