"""Every query with SQL against that SQL on the smallest given tables."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert difference(spark, con, SF, entry.queries()[name], ORACLES[name]) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_finds_the_known_events(spark):
    assert entry.entry(spark).count() == 113


def test_gap_rules_differ_on_the_given_tables(spark):
    queries = entry.queries()
    sf = "/root/testdata/sf0.01"
    assert queries["heat_events_rows"](spark, sf).count() == 1165
    assert queries["heat_events_calendar_stations"](spark, sf).count() == 69
