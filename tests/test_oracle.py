"""Every registered batch and stream query against its SQL, and the edges of the operators."""

from __future__ import annotations

import os

import duckdb
import pytest

from tests.conftest import SF
from tickgrid.plans.queries import ORACLE_SQL, QUERIES


#: Queries that give no rows at the smallest scale, but at the larger ones.
EMPTY_AT_SMALLEST = {"j11_feasible_sets"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: round(float(x), 4) if isinstance(x, float) else x
    return sorted((tuple(str(clean(r[i])) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    if name == "j3_radius_join":
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    df = QUERIES[name](spark, SF)
    want = db.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = want.fetchall()
    assert rows or name in EMPTY_AT_SMALLEST, "a check on no rows shows nothing"
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(want.columns, rows)
