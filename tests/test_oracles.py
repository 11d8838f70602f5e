"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import os

import pytest
from oracle_check import connect, difference

import __spark_entry__ as contract
from oracles import ORACLES
from wayfreight.plans.catalogue import QUERIES

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(contract.queries()) >= set(contract.oracle_sql()) >= set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert difference(contract.queries()[name](spark, DATA), con, contract.oracle_sql()[name]) is None


def test_entry_gives_one_row_per_application(spark):
    report = contract.entry(spark)
    assert len(report.columns) == 12
    assert report.count() == 30
