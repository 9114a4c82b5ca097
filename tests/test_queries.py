"""Every query of the core gives the rows of its SQL."""

import oracle
import pytest

import __spark_entry__ as entry
from vektora.plans import catalogue

QUERIES = {n: f for part in catalogue() for n, f in part.QUERIES.items()}
ORACLES = {n: s for part in catalogue() for n, s in part.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_of_the_sql(spark, sf, name):
    _, differing = oracle.same(QUERIES[name](spark, sf), ORACLES[name], sf)
    assert not differing


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() == 5 and "ndcg10" in df.columns
