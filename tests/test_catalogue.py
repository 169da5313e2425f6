from __future__ import annotations

import pytest
from oracle import SF, comparable, connect

from nearmatch.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, con, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF), con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert comparable(ours.columns, ours.collect()) == comparable(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_works_without_the_training_data_operators(spark):
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["group_id", "video_id"]
