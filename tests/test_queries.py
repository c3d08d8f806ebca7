"""Every query that SQL can express, against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from claimloom.plans.oracle import ORACLES
from claimloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan" if math.isnan(v) else round(v, 9) + 0.0)
    return (3, v) if isinstance(v, int) else (4, str(v))


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert table(df.columns, df.collect()) == table(want.columns, want.fetchall())


def test_every_query_has_sql_or_a_brute_force_test():
    brute = {"clusters_normalized", "clusters_token_jaccard", "claim_groups_normalized", "disagreements", "contradictions", "assembled_sentences", "segment_sentences"}
    assert set(QUERIES) - set(ORACLES) == brute
