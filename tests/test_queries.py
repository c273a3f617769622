"""Every query against DuckDB on the smallest tables. Those of the training-data folder have tests of their own."""

import pytest

import __spark_entry__ as entry
from pairloom.plans.queries import QUERIES
from tools.compare import compare, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_same_as_sql(spark, db, name):
    verdict, *_ = compare(spark, db, name, SF)
    assert verdict == "equal"


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["pair_id", "split", "input_ids", "targ_in", "targ_out"]
    assert df.count() > 0
