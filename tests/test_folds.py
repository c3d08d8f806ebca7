"""Queries that fold in order, against the recursive SQL of the same."""

import pytest

import __spark_entry__
from claimloom.plans.folds import ORACLES
from test_queries import SF, con, table  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):  # noqa: F811
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(ORACLES[name])
    rows = want.fetchall()
    # the tables' own turns hold no group that both promotes and doubts
    assert bool(rows) == (name not in ("disagreements", "contradictions"))
    assert table(df.columns, df.collect()) == table(want.columns, rows)
