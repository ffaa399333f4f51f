"""Every registered query against its SQL, on the smallest scale."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry
from lexsnap.plans import catalog, oracles

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(TESTDATA)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracles.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(oracles.oracle_sql()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, TESTDATA)
    assert oracle.mismatch(df, con, entry.oracle_sql()[name]) is None


def test_flagship(spark):
    counts = {r["op"]: r["n"] for r in entry.entry(spark).collect()}
    assert counts == {"insert": 11, "update": 14, "delete": 12, "same": 91}
