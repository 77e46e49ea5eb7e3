"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from shelfwatch.plans import oracles as library_oracles
from shelfwatch.plans import queries as library_queries

QUERIES, ORACLES = library_queries.queries(), library_oracles.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    ours, theirs, only_ours, only_theirs = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert (ours, only_ours, only_theirs) == (theirs, [], [])


def test_entry_is_the_version_diff(spark):
    assert entry.entry(spark).count() == 19476


def test_known_totals(spark, sf_dir):
    assert QUERIES["dedupe_versions"](spark, sf_dir).count() == 5703
    assert QUERIES["baselines"](spark, sf_dir).count() == 200
