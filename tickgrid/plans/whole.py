"""Whole-table forms of queries whose SQL in ``plans.queries`` holds for a part of the rows only.

Roles come from attributes, so every row takes part. Regions here are found by runs of
cells, those of ``plans.queries`` by tiles; a test compares both with a plain search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickgrid.operators import aggregates as A
from tickgrid.operators import grid as G
from tickgrid.operators import joins as J
from tickgrid.operators import ranking as R
from tickgrid.plans.queries import ORACLE_SQL as ORACLE_OF
from tickgrid.plans.queries import REGIONS, Source, walled
from tickgrid.sources.fixtures import duckdb_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function of a Source, with the SQL that gives the same rows."""

    def add(f: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        ORACLE_SQL[f.__name__] = sql if sql.startswith("WITH RECURSIVE v_") else duckdb_views(sql)
        return f

    return add


@query(ORACLE_OF["g6_regions"])
def g6_regions_whole(v):
    """The regions by contracted runs of cells instead of tiles."""
    return G.regions_by_runs(walled(v.cells)).select("cell_id", "region")


@query(ORACLE_OF["j10_reachable"])
def j10_reachable_whole(v):
    """All cells that can be reached from each player's start, over those regions."""
    a = v.players.select(F.col("player").alias("a_id"), "x", "y")
    return J.reachable(a, v.cells.select(F.col("cell_id").alias("b_id"), "x", "y"), G.regions_by_runs(walled(v.cells)), "a_id", "b_id")


@query(f"""WITH RECURSIVE {REGIONS}, place AS (SELECT f.x, f.y, r.region FROM free f JOIN reg r ON f.cell_id = r.cell_id)
    SELECT 'stands' AS how, a.player AS id, s.region FROM v_players a JOIN place s ON a.x = s.x AND a.y = s.y
    UNION ALL SELECT DISTINCT 'touches', b.cell_id, p.region FROM v_cells b JOIN (VALUES (-1), (0), (1)) i(dx) ON true JOIN (VALUES (-1), (0), (1)) j(dy) ON true JOIN place p ON p.x = b.x + i.dx AND p.y = b.y + j.dy""")
def j10_reachable_regions_whole(v):
    """The same in a row for each player and up to nine for each cell, instead of pairs."""
    labels = G.regions(walled(v.cells))
    a = J.standing(v.players, labels, "player").select(F.lit("stands").alias("how"), F.col("player").alias("id"), "region")
    return a.unionByName(J.touching(v.cells, labels, "cell_id").select(F.lit("touches").alias("how"), F.col("cell_id").alias("id"), "region"))


@query("""WITH need AS (SELECT DISTINCT family AS set_id, class AS item FROM v_kinds), have AS (SELECT DISTINCT k.class AS item FROM v_units u JOIN v_kinds k ON u.kind_id = k.kind_id)
    SELECT DISTINCT set_id FROM need n WHERE NOT EXISTS (SELECT 1 FROM need m WHERE m.set_id = n.set_id AND NOT EXISTS (SELECT 1 FROM have h WHERE h.item = m.item))""")
def j11_feasible_sets_whole(v):
    sets = v.kinds.groupBy(F.col("family").alias("set_id"), "class").count().groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("class", "count"))).alias("members"))
    return J.feasible_sets(sets, v.units.join(v.kinds, "kind_id").select(F.col("class").alias("item")))


@query("""WITH t AS (SELECT kind AS item, 3 * count(*) // 2 AS target FROM v_events WHERE tick < 20000 GROUP BY 1), a AS (SELECT kind AS item, count(*) AS n FROM v_events WHERE tick >= 20000 GROUP BY 1)
    SELECT t.item, t.target, t.target - coalesce(a.n, 0) AS missing FROM t LEFT JOIN a ON t.item = a.item WHERE t.target > 0 AND t.target > coalesce(a.n, 0)""")
def j12_missing_members_whole(v):
    target = v.events.filter("tick < 20000").groupBy(F.col("kind").alias("item")).agg(F.expr("3 * count(*) div 2").alias("target"))
    return J.missing_members(target, v.events.filter("tick >= 20000").select(F.col("kind").alias("item")))


@query("""WITH a AS (SELECT key AS unit_id, kind AS group_id FROM v_events WHERE tick >= 20000), u AS (SELECT DISTINCT key AS unit_id FROM v_events WHERE tick < 20000)
    SELECT unit_id, 'dead' AS problem FROM (SELECT DISTINCT unit_id FROM a) WHERE unit_id NOT IN (SELECT unit_id FROM u) UNION ALL SELECT unit_id, 'shared' FROM a GROUP BY unit_id HAVING count(DISTINCT group_id) > 1""")
def j13_audit_assignments_whole(v):
    assign = v.events.filter("tick >= 20000").select(F.col("key").alias("unit_id"), F.col("kind").alias("group_id"))
    return J.audit_assignments(assign, v.events.filter("tick < 20000").select(F.col("key").alias("unit_id")).distinct())


@query("""WITH h AS (SELECT * FROM v_units WHERE stance = 'R'), r AS (SELECT * FROM v_units WHERE stance = 'N'), b AS (SELECT * FROM v_units WHERE stance NOT IN ('R', 'N')),
    o AS (SELECT b.owner, count(*) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.owner = b.owner AND r.x >= b.x - 8 AND r.x < b.x + 9 AND r.y >= b.y - 8 AND r.y < b.y + 9) GROUP BY 1),
    t AS (SELECT d.owner, coalesce((SELECT count(*) FROM h WHERE h.owner = d.owner), 0) AS h, coalesce((SELECT count(*) FROM r WHERE r.owner = d.owner), 0) AS r, coalesce(o.n, 0) AS o FROM (SELECT DISTINCT owner FROM b) d LEFT JOIN o ON d.owner = o.owner)
    SELECT owner, CAST(greatest(1, least(6, 2 * h * (o + 1))) AS BIGINT) AS cap, round(r / greatest(h / 2.0, 1.0) * CASE WHEN h < 2 THEN 3 WHEN h > r * 4 THEN 0 ELSE 1 END, 4) AS priority FROM t""")
def a14_capacity_plan_whole(v):
    pick = lambda of: v.units.filter(of).select("unit_id", "owner", "x", "y")
    return A.capacity_plan(pick("stance = 'R'"), pick("stance = 'N'"), pick("stance not in ('R', 'N')"), 8).withColumn("priority", F.round("priority", 4))


@query("""WITH e AS (SELECT a.player AS viewer, b.player AS owner FROM v_players a JOIN v_players b ON a.team <> b.team AND b.is_combatant AND NOT b.is_neutral WHERE a.is_combatant),
    t AS (SELECT * FROM (SELECT owner, unit_id, x, y, CASE WHEN stance = 'R' AND zone = 'F' AND hp = 50 THEN 100000 WHEN stance = 'N' THEN max_hp * 10 ELSE max_hp END AS weight FROM v_units) QUALIFY row_number() OVER (PARTITION BY owner ORDER BY weight DESC, unit_id) = 1),
    u AS (SELECT e.viewer, t.* FROM e JOIN t ON e.owner = t.owner QUALIFY row_number() OVER (PARTITION BY e.viewer ORDER BY t.weight DESC, t.unit_id) = 1),
    s AS (SELECT e.viewer, e.owner, p.x, p.y FROM e JOIN v_players p ON e.owner = p.player JOIN v_cells c ON c.x = p.x AND c.y = p.y AND NOT c.visible QUALIFY row_number() OVER (PARTITION BY e.viewer ORDER BY e.owner) = 1)
    SELECT p.player AS viewer, CASE WHEN u.viewer IS NOT NULL THEN 'unit' WHEN s.viewer IS NOT NULL THEN 'start' ELSE 'none' END AS kind, u.unit_id, coalesce(u.x, s.x) AS x, coalesce(u.y, s.y) AS y FROM v_players p LEFT JOIN u ON p.player = u.viewer LEFT JOIN s ON p.player = s.viewer""")
def w9_pick_target_whole(v):
    a = v.players.filter("is_combatant").select(F.col("player").alias("viewer"), F.col("team").alias("vt"))
    enemies = a.join(v.players.filter("is_combatant and not is_neutral"), F.col("vt") != F.col("team")).select("viewer", F.col("player").alias("owner"))
    focus = (F.col("stance") == "R") & (F.col("zone") == "F") & (F.col("hp") == 50)
    starts = J.unseen_starts(v.players, v.cells, F.lit(False))
    return R.pick_target(v.units, v.players.select(F.col("player").alias("viewer")), enemies, starts, focus, F.col("stance") == "N")
