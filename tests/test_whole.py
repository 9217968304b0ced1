"""Whole-table queries against their SQL, and regions and reachability against a plain search."""

from __future__ import annotations

import pytest

import __spark_entry__
from tests.conftest import SF
from tests.test_oracle import _rows, db  # noqa: F401
from tickgrid.plans import busy, whole
from tickgrid.sources.fixtures import view


QUERIES, ORACLE_SQL = whole.QUERIES | busy.QUERIES, whole.ORACLE_SQL | busy.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_whole_query_matches_sql(spark, db, name):  # noqa: F811
    df, want = QUERIES[name](spark, SF), db.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(want.columns, want.fetchall())


def test_regions_and_reachability_cover_the_grid(spark):
    cells = {(c.x, c.y): (c.cell_id, c.blocked or c.cell_id % 7 == 0 or c.cell_id % 11 == 3) for c in view(spark, SF, "v_cells").collect()}
    region: dict = {}
    for start in sorted((p for p, (_, wall) in cells.items() if not wall), key=lambda p: cells[p][0]):
        todo = [start] if start not in region else []
        while todo:
            x, y = at = todo.pop()
            if at in cells and not cells[at][1] and at not in region:
                region[at] = cells[start][0]
                todo += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
    queries = __spark_entry__.queries()
    got = {r.cell_id: r.region for r in queries["g6_regions_whole"](spark, SF).collect()}
    assert got == {cells[p][0]: r for p, r in region.items()} and len(got) > 144
    ring = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    touched = {i: {region.get((x + a, y + b)) for a, b in ring} - {None} for (x, y), (i, _) in cells.items()}
    players = {p.player: region.get((p.x, p.y)) for p in view(spark, SF, "v_players").collect()}
    want = {(p, i) for p, r in players.items() for i, near in touched.items() if r in near}
    pairs = queries["j10_reachable_whole"](spark, SF).collect()
    assert {(r.a_id, r.b_id) for r in pairs} == want and len(pairs) == len(want) > 0
    rows = queries["j10_reachable_regions_whole"](spark, SF).collect()
    assert {(r.id, r.region) for r in rows if r.how == "stands"} == {(p, r) for p, r in players.items() if r is not None}
    assert {(r.id, r.region) for r in rows if r.how == "touches"} == {(i, r) for i, near in touched.items() for r in near}
