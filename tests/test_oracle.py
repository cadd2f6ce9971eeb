"""Every registered query equals its DuckDB statement, whole tables on both sides."""

import decimal

import pytest

import __spark_entry__ as contract
from tripledger.plans.oracle import all_oracles
from tripledger.plans.queries import all_queries

ORACLES = all_oracles()
QUERIES = all_queries()
ROWS_ONLY = set()


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


def _sorted(names, rows):
    order = sorted(names)
    at = [names.index(n) for n in order]
    return order, sorted((tuple(repr(_plain(row[i])) for i in at) for row in rows))


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(name, spark, duck, sf_dir):
    found = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLES[name])
    names = [d[0] for d in expected.description]
    assert _sorted(found.columns, found.collect()) == _sorted(names, expected.fetchall())


def test_entry(spark):
    assert {r["dedup_status"] for r in contract.entry(spark).collect()} == {
        "net_new", "exact_duplicate", "near_match", "conflict",
    }
