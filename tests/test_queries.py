"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from gleanframe.queries import ORACLE, QUERIES
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert rows and {r.decision for r in rows} == {"Done"}


def test_names():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLE) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    problem, _, _ = compare(spark, duck, name, FOLDER)
    assert problem is None
