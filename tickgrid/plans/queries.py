"""Registered queries: each operator over the benchmark tables, beside its SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickgrid.operators import aggregates as A
from tickgrid.operators import grid as G
from tickgrid.operators import joins as J
from tickgrid.operators import predicates as P
from tickgrid.operators import ranking as R
from tickgrid.operators import temporal as T
from tickgrid.operators.rules import standard_rules, with_parameters
from tickgrid.sources import tables as S
from tickgrid.sources.fixtures import duckdb_views, event_time, view
from tickgrid.sources.shared import shared_dir
from tickgrid.streaming import operators as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VIEWER = 3


class Source:
    """The fixture views and tables of one scale."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, f"v_{name}")


def query(sql: str | None):
    """Register a function of a Source, with the SQL that gives the same rows."""

    def add(f: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = duckdb_views(sql)
        return f

    return add


def r4(column: str):
    return F.round(column, 4).alias(column)


RELATION = f"""CASE WHEN u.owner = {VIEWER} THEN 'self' WHEN p.team IS NULL OR p.is_neutral THEN 'neutral'
    WHEN p.team = (SELECT team FROM v_players WHERE player = {VIEWER}) THEN 'ally' WHEN NOT p.is_combatant THEN 'non_combatant' ELSE 'enemy' END"""
POWER = """least(800.0, coalesce((coalesce(hp, 0) / greatest(1.0, coalesce(max_hp, 0))) * (w1.damage + 1) * sqrt(w1.range + 1) / greatest(w1.rof, 1.0), 0.0)
    + coalesce((coalesce(hp, 0) / greatest(1.0, coalesce(max_hp, 0))) * (w2.damage + 1) * sqrt(w2.range + 1) / greatest(w2.rof, 1.0), 0.0))"""

# --- scans and sinks -----------------------------------------------------------------


@query("SELECT cell_id, x, y, amount FROM v_cells WHERE x >= 20 AND x < 60 AND y >= 10 AND y < 50")
def s1_scan_cells(v):
    return S.scan_cells(v.cells, 20, 10, 40, 40).select("cell_id", "x", "y", "amount")


@query("SELECT cell_id, x, y, amount FROM v_cells WHERE x >= 20 AND x < 60 AND y >= 10 AND y < 50")
def s1_scan_stored(v):
    at = f"{shared_dir(v.spark)}/cells-{uuid.uuid4().hex}"
    S.store_cells(v.cells.select("cell_id", "x", "y", "amount"), at, side=32)
    return S.scan_stored(v.spark, at, 20, 10, 40, 40, side=32).select("cell_id", "x", "y", "amount")


@query(f"""SELECT u.unit_id, u.owner, u.kind_id FROM v_units u JOIN v_players p ON u.owner = p.player JOIN v_kinds k ON u.kind_id = k.kind_id
    WHERE u.owner <> {VIEWER} AND NOT (p.team = (SELECT team FROM v_players WHERE player = {VIEWER}) AND NOT p.is_neutral) AND NOT p.is_neutral AND p.is_combatant AND k.cost > 905""")
def s2_scan_units(v):
    return S.scan_units(v.units, v.players, v.kinds, VIEWER, "enemy", F.col("cost") > 905).select("unit_id", "owner", "kind_id")


@query("SELECT event_id, key, kind, value FROM v_events")
def s3_event_stream(v):
    stream = S.event_stream(v.spark, f"{v.sf_dir}/event[s].parquet")
    return ST.run_to_table(stream.select("event_id", F.col("user_id").alias("key"), F.col("event_type").alias("kind"), "value"), shared_dir(v.spark))


@query("SELECT kind AS tag, tick, event_id, value FROM v_events WHERE tick % 360 = 0")
def s4_export_snapshots(v):
    rows = v.events.select(F.col("kind").alias("tag"), "tick", "event_id", "value")
    out = S.export_snapshots(rows, f"{shared_dir(v.spark)}/snapshots-{uuid.uuid4().hex}", 360)
    return out.select("tag", F.col("tick").cast("long").alias("tick"), "event_id", "value")


@query("SELECT kind AS tag, tick, event_id, value FROM v_events WHERE tick % 360 = 0")
def s4_stream_snapshots(v):
    rows = _stream(v).select(F.col("kind").alias("tag"), "tick", "event_id", "value")
    at = f"{shared_dir(v.spark)}/snapshots-{uuid.uuid4().hex}"
    return ST.stream_snapshots(rows, f"{at}/out", 360, f"{at}/state")


# --- projections and filters -----------------------------------------------------------


@query(f"SELECT {RELATION} AS relation, count(*) AS n, sum(u.hp) AS hp FROM v_units u LEFT JOIN v_players p ON u.owner = p.player GROUP BY 1")
def p1_classify_relation(v):
    return P.classify_relation(v.units, v.players, VIEWER)


@query("SELECT unit_id, kind_id FROM v_units WHERE kind_id IN (SELECT kind_id FROM v_kinds WHERE class IN (SELECT DISTINCT class FROM v_kinds ORDER BY class LIMIT 2) AND primary_w IS NOT NULL)")
def p2_filter_class(v):
    classes = [r[0] for r in v.kinds.select("class").distinct().orderBy("class").limit(2).collect()]
    return P.filter_class(v.units, v.kinds, classes, combatant=True).select("unit_id", "kind_id")


@query("SELECT cell_id, x, y FROM v_cells WHERE terrain IN ('1-URGENT', '2-HIGH') AND NOT blocked AND coalesce(amount, 0) <= 100000")
def p3_buildable_cells(v):
    return P.buildable_cells(v.cells, ["1-URGENT", "2-HIGH"], 100000).select("cell_id", "x", "y")


@query("SELECT unit_id, hp FROM v_units WHERE hp > 0 AND hp < max_hp AND zone <> 'F'")
def p4_damaged_units(v):
    return P.damaged_units(v.units, F.col("zone") == "F").select("unit_id", "hp")


@query("""SELECT cell_id, CASE WHEN ok THEN CAST(floor(x / 8.0) AS INT) END AS sx, CASE WHEN ok THEN CAST(floor(y / 8.0) AS INT) END AS sy,
    CASE WHEN ok THEN CAST(floor(x / 8.0) AS BIGINT) | (CAST(floor(y / 8.0) AS BIGINT) << 16) END AS sector_id,
    CASE WHEN ok THEN CAST(floor(floor(x / 8.0) * 8 + 4) AS INT) END AS cx, CASE WHEN ok THEN CAST(floor(floor(y / 8.0) * 8 + 4) AS INT) END AS cy
    FROM (SELECT *, x BETWEEN 0 AND 119 AND y BETWEEN 0 AND 99 AS ok FROM v_cells)""")
def p5_bin_cells(v):
    return P.bin_cells(v.cells, 8, 120, 100).select("cell_id", "sx", "sy", "sector_id", "cx", "cy")


@query("""WITH m AS (SELECT CAST(floor(x / 8.0) AS INT) AS sx, CAST(floor(y / 8.0) AS INT) AS sy, avg(amount) AS mean FROM v_cells GROUP BY 1, 2),
    r AS (SELECT *, 2 * least(greatest((mean - min(mean) OVER ()) / nullif(max(mean) OVER () - min(mean) OVER (), 0), 0), 1) AS ratio FROM m),
    c AS (SELECT *, floor(greatest(0, 255 * (1 - ratio))) AS b, floor(greatest(0, 255 * (ratio - 1))) AS r FROM r)
    SELECT sx, sy, round(mean, 2) AS mean, coalesce(CAST(r * 65536 + (255 - b - r) * 256 + b AS BIGINT), 0) AS colour FROM c""")
def p6_heatmap_table(v):
    return P.heatmap_table(v.cells, "amount", 8).withColumn("mean", F.round("mean", 2))


@query("""SELECT event_id, printf('%d:%02d:%02d', tick // 3600, tick // 60 % 60, tick % 60) AS clock, least(0.75, greatest(0.25, 1 - (43200 - tick) / 600.0)) AS weight FROM v_events""")
def p7_log_report(v):
    return P.log_report(v.events, 43200).select("event_id", "clock", "weight")


_PAIRS = """SELECT u.unit_id, p.player, CASE WHEN u.stance <> 'R' THEN u.stance END AS stance, CAST(u.hp AS DOUBLE) AS reach, u.x AS ax, u.y AS ay, p.x AS tx, p.y AS ty FROM v_units u JOIN v_players p ON u.owner % 5 = p.team"""


@query(f"""SELECT unit_id, player, round(d, 4) AS distance, CASE WHEN stance IS NOT NULL AND stance <> 'N' AND d <= reach THEN 'deploy' WHEN stance = 'N' AND d > reach THEN 'undeploy'
    WHEN d < reach * 0.8 THEN 'attack' ELSE 'attack_move' END AS "order" FROM (SELECT *, sqrt((ax - tx) * (ax - tx) + (ay - ty) * (ay - ty)) AS d FROM ({_PAIRS}))""")
def p8_choose_order(v):
    u = v.units.select("unit_id", F.when(F.col("stance") != "R", F.col("stance")).alias("stance"), F.col("hp").alias("reach"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("owner") % 5).alias("team"))
    pairs = u.join(v.players.select("player", "team", F.col("x").alias("tx"), F.col("y").alias("ty")), "team")
    return P.choose_order(pairs).select("unit_id", "player", r4("distance"), "order")


# --- joins -------------------------------------------------------------------------------


@query("""SELECT u.unit_id, coalesce(a.class, b.class, c.class, d.class) AS class, coalesce(a.cost, b.cost, c.cost, d.cost) AS cost,
    CAST(CASE WHEN a.kind_id IS NOT NULL THEN 0 WHEN b.kind_id IS NOT NULL THEN 1 WHEN c.kind_id IS NOT NULL THEN 2 WHEN d.kind_id IS NOT NULL THEN 3 END AS INT) AS source
    FROM v_units u LEFT JOIN (SELECT * FROM v_kinds WHERE kind_id % 7 = 0) a ON u.kind_id = a.kind_id LEFT JOIN (SELECT * FROM v_kinds WHERE kind_id % 5 = 0) b ON u.kind_id = b.kind_id
    LEFT JOIN (SELECT * FROM v_kinds WHERE kind_id % 3 = 0) c ON u.kind_id = c.kind_id LEFT JOIN (SELECT * FROM v_kinds WHERE kind_id % 2 = 0) d ON u.kind_id = d.kind_id""")
def j1_resolve_rules(v):
    dims = [v.kinds.filter(F.col("kind_id") % n == 0) for n in (7, 5, 3, 2)]
    return J.resolve_rules(v.units, "kind_id", *dims).select("unit_id", "class", "cost", "source")


@query("""SELECT unit_id FROM v_units u WHERE EXISTS (SELECT 1 FROM v_kinds k JOIN v_weapons w ON w.weapon_id IN (k.primary_w, k.secondary_w) JOIN v_projectiles p ON w.projectile_id = p.projectile_id
    WHERE p.anti_air AND k.kind_id = u.kind_id)""")
def j2_weapon_any(v):
    return J.weapon_any(v.units, v.kinds, v.weapons, v.projectiles, "anti_air").select("unit_id")


_J3 = "SELECT c.cell_id, p.player, round(sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)), 4) AS distance FROM v_cells c JOIN v_players p ON (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) <= 144"
_J4 = "SELECT c.cell_id, p.player FROM v_cells c JOIN v_players p ON c.x >= p.x - 6 AND c.x < p.x + 7 AND c.y >= p.y - 6 AND c.y < p.y + 7"


@query(_J3)
def j3_radius_join_tiled(v):
    return J.radius_join_tiled(v.cells.select("cell_id", "x", "y"), v.players.select("player", "x", "y"), 12, most=50).select("cell_id", "player", r4("distance"))


@query(_J4)
def j4_box_join_tiled(v):
    boxes = v.players.select("player", (F.col("x") - 6).alias("x0"), (F.col("y") - 6).alias("y0"), (F.col("x") + 7).alias("x1"), (F.col("y") + 7).alias("y1"))
    return J.box_join_tiled(v.cells.select("cell_id", "x", "y"), boxes, 13, most=50).select("cell_id", "player")


@query(_J3)
def j3_radius_join(v):
    return J.radius_join(v.cells.select("cell_id", "x", "y"), v.players.select("player", "x", "y"), 12).select("cell_id", "player", r4("distance"))


@query(_J4)
def j4_box_join(v):
    boxes = v.players.select("player", (F.col("x") - 6).alias("x0"), (F.col("y") - 6).alias("y0"), (F.col("x") + 7).alias("x1"), (F.col("y") + 7).alias("y1"))
    return J.box_join(v.cells.select("cell_id", "x", "y"), boxes, 13).select("cell_id", "player")


@query("""SELECT cell_id, player, round(d, 4) AS distance FROM (SELECT c.cell_id, p.player, sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) AS d,
    row_number() OVER (PARTITION BY c.cell_id ORDER BY (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y), p.player) AS n FROM v_cells c CROSS JOIN v_players p) WHERE n = 1""")
def j5_nearest(v):
    return J.nearest(v.cells.select("cell_id", "x", "y"), v.players.select("player", "x", "y"), "cell_id", "player", 16).select("cell_id", "player", r4("distance"))


@query(f"""WITH e AS (SELECT p.x, p.y FROM v_players p WHERE p.player <> {VIEWER} AND NOT p.is_neutral AND p.is_combatant AND p.team <> (SELECT team FROM v_players WHERE player = {VIEWER}))
    SELECT DISTINCT t.tick, c.cell_id AS point_id FROM (SELECT unnest(range(0, 10)) AS tick) t JOIN v_cells c ON c.blocked JOIN e ON sqrt((c.x - e.x) * (c.x - e.x) + (c.y - e.y) * (c.y - e.y)) <= 2 + 0.5 * t.tick""")
def j6_growing_radius_alert(v):
    mine = v.players.filter(F.col("player") == VIEWER).select(F.col("team").alias("t"))
    enemies = v.players.crossJoin(F.broadcast(mine)).filter((F.col("player") != VIEWER) & ~F.col("is_neutral") & F.col("is_combatant") & (F.col("team") != F.col("t"))).select("x", "y")
    points = v.cells.filter("blocked").select(F.col("cell_id").alias("point_id"), "x", "y")
    return J.growing_radius_alert(points, enemies, 2, 0.5, 9)


@query(f"""WITH a AS (SELECT CAST(floor(x / 8.0) AS INT) AS sx, CAST(floor(y / 8.0) AS INT) AS sy, sum(coalesce(amount, 0)) AS amount FROM v_cells GROUP BY 1, 2)
    SELECT c.cell_id, c.x, c.y FROM v_cells c LEFT JOIN a ON a.sx = CAST(floor(c.x / 8.0) AS INT) AND a.sy = CAST(floor(c.y / 8.0) AS INT) WHERE c.visible AND (coalesce(a.amount, 0) >= 9000000 OR coalesce(a.amount, 0) = 0)
    AND NOT EXISTS (SELECT 1 FROM v_players p WHERE (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) < 100)""")
def j7_filter_far_candidates(v):
    return J.filter_far_candidates(v.cells.filter("visible"), v.players, A.amount_per_sector(v.cells, 8), 9_000_000, 10, 8)


@query("""WITH att AS (SELECT p.player AS squad, w.weapon_id AS unit_id, (p.x + w.weapon_id % 4) AS x, (p.y + w.weapon_id // 4) AS y, w.range AS reach, r.anti_air, r.anti_ground
      FROM v_players p JOIN v_weapons w ON w.weapon_id % 5 = p.team JOIN v_projectiles r ON w.projectile_id = r.projectile_id),
    tgt AS (SELECT cell_id AS target_id, x, y, visible AS airborne FROM v_cells WHERE amount < 20000),
    lead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY squad ORDER BY reach, unit_id) AS n FROM att) WHERE n = 1),
    seen AS (SELECT l.squad, t.* FROM lead l JOIN tgt t ON (l.x - t.x) * (l.x - t.x) + (l.y - t.y) * (l.y - t.y) <= 225),
    best AS (SELECT a.squad, a.unit_id, s.target_id, sqrt((a.x - s.x) * (a.x - s.x) + (a.y - s.y) * (a.y - s.y)) AS d FROM att a JOIN seen s ON a.squad = s.squad WHERE CASE WHEN s.airborne THEN a.anti_air ELSE a.anti_ground END)
    SELECT squad, unit_id, target_id, round(d, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY squad, unit_id ORDER BY d, target_id) AS n FROM best) WHERE n = 1""")
def j8_best_target(v):
    att = v.players.select(F.col("player").alias("squad"), "team", F.col("x").alias("px"), F.col("y").alias("py")).join(v.weapons.withColumn("team", F.col("weapon_id") % 5), "team").join(v.projectiles, "projectile_id")
    att = att.select("squad", F.col("weapon_id").alias("unit_id"), (F.col("px") + F.col("weapon_id") % 4).alias("x"), (F.col("py") + F.expr("cast(weapon_id div 4 as int)")).alias("y"), F.col("range").alias("reach"), "anti_air", "anti_ground")
    tgt = v.cells.filter("amount < 20000").select(F.col("cell_id").alias("target_id"), "x", "y", F.col("visible").alias("airborne"))
    return J.best_target(att, tgt, 15).select("squad", "unit_id", "target_id", r4("distance"))


@query("""WITH s(dx, dy, weight, direction) AS (VALUES (-1, -1, 0.707, 'NW'), (0, -1, 1.0, 'N'), (1, -1, 0.707, 'NE'), (-1, 0, 1.0, 'W'), (1, 0, 1.0, 'E'), (-1, 1, 0.707, 'SW'), (0, 1, 1.0, 'S'), (1, 1, 0.707, 'SE'))
    SELECT a.cell_id, b.cell_id AS neighbour, CAST(s.weight AS DOUBLE) AS weight, s.direction FROM v_cells a CROSS JOIN s JOIN v_cells b ON b.x = a.x + s.dx AND b.y = a.y + s.dy""")
def j9_neighbours8(v):
    return J.neighbours8(v.cells)


#: Regions of the walled grid: a cell takes the smallest label next to it until none is smaller. Labels are keyed by cell, so no pair of cells is kept.
REGIONS = """free AS MATERIALIZED (SELECT cell_id, x, y FROM v_cells WHERE NOT (blocked OR cell_id % 7 = 0 OR cell_id % 11 = 3)),
    link AS MATERIALIZED (SELECT a.cell_id AS a, b.cell_id AS b FROM free a JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy) ON true JOIN free b ON b.x = a.x + d.dx AND b.y = a.y + d.dy),
    reg(cell_id, region) USING KEY (cell_id) AS (SELECT cell_id, cell_id FROM free
        UNION SELECT l.b, min(r.region) FROM reg r JOIN link l ON r.cell_id = l.a JOIN recurring.reg o ON o.cell_id = l.b WHERE r.region < o.region GROUP BY l.b)"""


def walled(cells: DataFrame) -> DataFrame:
    """All cells, with walls added so that they fall into several regions."""
    return cells.withColumn("blocked", F.col("blocked") | (F.col("cell_id") % 7 == 0) | (F.col("cell_id") % 11 == 3))


@query(f"""WITH RECURSIVE {REGIONS}, place AS (SELECT f.x, f.y, r.region FROM free f JOIN reg r ON f.cell_id = r.cell_id),
    next AS (SELECT DISTINCT b.cell_id, p.region FROM v_cells b JOIN (VALUES (-1), (0), (1)) i(dx) ON true JOIN (VALUES (-1), (0), (1)) j(dy) ON true JOIN place p ON p.x = b.x + i.dx AND p.y = b.y + j.dy)
    SELECT a.player AS a_id, n.cell_id AS b_id FROM v_players a JOIN place s ON a.x = s.x AND a.y = s.y JOIN next n ON n.region = s.region""")
def j10_reachable(v):
    a = v.players.select(F.col("player").alias("a_id"), "x", "y")
    return J.reachable(a, v.cells.select(F.col("cell_id").alias("b_id"), "x", "y"), G.regions(walled(v.cells)), "a_id", "b_id")


@query("""WITH need AS (SELECT DISTINCT family AS set_id, class AS item FROM v_kinds), have AS (SELECT DISTINCT k.class AS item FROM v_units u JOIN v_kinds k ON u.kind_id = k.kind_id WHERE u.owner < 2 AND u.x < 100)
    SELECT DISTINCT set_id FROM need n WHERE NOT EXISTS (SELECT 1 FROM need m WHERE m.set_id = n.set_id AND NOT EXISTS (SELECT 1 FROM have h WHERE h.item = m.item))""")
def j11_feasible_sets(v):
    sets = v.kinds.groupBy(F.col("family").alias("set_id"), "class").count().groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("class", "count"))).alias("members"))
    have = v.units.filter("owner < 2 and x < 100").join(v.kinds, "kind_id").select(F.col("class").alias("item"))
    return J.feasible_sets(sets, have)


@query("""WITH t AS (SELECT kind AS item, 3 * count(*) // 2 AS target FROM v_events WHERE tick < 20000 GROUP BY 1), a AS (SELECT kind AS item, count(*) AS n FROM v_events WHERE tick >= 20000 AND key % 2 = 0 GROUP BY 1)
    SELECT t.item, t.target, t.target - coalesce(a.n, 0) AS missing FROM t LEFT JOIN a ON t.item = a.item WHERE t.target > 0 AND t.target > coalesce(a.n, 0)""")
def j12_missing_members(v):
    target = v.events.filter("tick < 20000").groupBy(F.col("kind").alias("item")).agg(F.expr("3 * count(*) div 2").alias("target"))
    return J.missing_members(target, v.events.filter("tick >= 20000 and key % 2 = 0").select(F.col("kind").alias("item")))


@query("""WITH a AS (SELECT key AS unit_id, kind AS group_id FROM v_events WHERE event_id % 3 = 0), u AS (SELECT DISTINCT key AS unit_id FROM v_events WHERE event_id % 3 = 1 AND value > 80)
    SELECT unit_id, 'dead' AS problem FROM (SELECT DISTINCT unit_id FROM a) WHERE unit_id NOT IN (SELECT unit_id FROM u) UNION ALL SELECT unit_id, 'shared' FROM a GROUP BY unit_id HAVING count(DISTINCT group_id) > 1""")
def j13_audit_assignments(v):
    assign = v.events.filter("event_id % 3 = 0").select(F.col("key").alias("unit_id"), F.col("kind").alias("group_id"))
    return J.audit_assignments(assign, v.events.filter("event_id % 3 = 1 and value > 80").select(F.col("key").alias("unit_id")).distinct())


@query(f"SELECT p.player, p.x, p.y FROM v_players p JOIN v_cells c ON c.x = p.x AND c.y = p.y WHERE p.player <> {VIEWER} AND NOT c.visible")
def j14_unseen_starts(v):
    return J.unseen_starts(v.players, v.cells, F.col("player") == VIEWER)


@query("""SELECT r.request_id, r.item, r.tick FROM v_requests r WHERE NOT EXISTS (SELECT 1 FROM v_requests c WHERE c.requester = 7 AND c.item = r.item AND c.tick BETWEEN r.tick AND r.tick + 120)""")
def j15_expired_requests(v):
    return J.expired_requests(v.requests, v.requests.filter("requester = 7"), 120).select("request_id", "item", "tick")


# --- aggregates ----------------------------------------------------------------------------


@query(f"""SELECT CAST(floor(u.x / 8.0) AS INT) AS sx, CAST(floor(u.y / 8.0) AS INT) AS sy, sum(CASE {RELATION} WHEN 'enemy' THEN coalesce(max_hp, 1) WHEN 'self' THEN -coalesce(max_hp, 1) ELSE 0 END) AS threat
    FROM v_units u LEFT JOIN v_players p ON u.owner = p.player GROUP BY 1, 2""")
def a1_sector_threat(v):
    return A.sector_threat(v.units, v.players, VIEWER, 8)


@query(f"""WITH t AS (SELECT {RELATION} AS rel, zone = 'F' AND stance <> 'N' AS ground, zone <> 'F' AS flying, stance = 'N' AS building, stance = 'R' AS combatant, {POWER} AS power,
      coalesce(p1.anti_ground, false) OR coalesce(p2.anti_ground, false) AS anti_ground, coalesce(p1.anti_air, false) OR coalesce(p2.anti_air, false) AS anti_air
      FROM v_units u LEFT JOIN v_players p ON u.owner = p.player LEFT JOIN v_kinds k ON u.kind_id = k.kind_id
      LEFT JOIN v_weapons w1 ON k.primary_w = w1.weapon_id LEFT JOIN v_weapons w2 ON k.secondary_w = w2.weapon_id
      LEFT JOIN v_projectiles p1 ON w1.projectile_id = p1.projectile_id LEFT JOIN v_projectiles p2 ON w2.projectile_id = p2.projectile_id),
    s AS (SELECT floor(x / 8.0) AS sx, floor(y / 8.0) AS sy, count(*) FILTER (terrain IS NOT NULL AND visible) / nullif(CAST(count(terrain) AS DOUBLE), 0) AS ratio FROM v_cells GROUP BY 1, 2)
    SELECT round((SELECT avg(ratio) FROM s), 6) AS certainty, round(coalesce(sum(power) FILTER (rel = 'enemy' AND ground), 0), 2) AS enemy_ground, round(coalesce(sum(power) FILTER (rel = 'enemy' AND flying), 0), 2) AS enemy_air,
      round(coalesce(sum(power) FILTER (rel = 'enemy' AND NOT building AND anti_air), 0), 2) AS enemy_anti_air, round(coalesce(sum(power) FILTER (rel = 'enemy' AND building AND anti_ground), 0), 2) AS enemy_defence,
      round(coalesce(sum(power) FILTER (rel = 'self' AND building AND anti_ground), 0), 2) AS own_defence, round(coalesce(sum(power) FILTER (rel = 'self' AND combatant AND anti_ground), 0), 2) AS own_anti_ground,
      round(coalesce(sum(power) FILTER (rel = 'self' AND (combatant OR building) AND anti_air), 0), 2) AS own_anti_air, round(coalesce(sum(power) FILTER (rel = 'self' AND flying AND combatant), 0), 2) AS own_air FROM t""")
def a2_power_totals(v):
    building = F.col("stance") == "N"
    out = A.power_totals(v.units, v.kinds, v.weapons, v.projectiles, v.players, v.cells, VIEWER, (F.col("zone") == "F") & ~building, F.col("zone") != "F", building, F.col("stance") == "R")
    return out.select(F.round("certainty", 6).alias("certainty"), *[F.round(c, 2).alias(c) for c in out.columns if c != "certainty"])


@query("""WITH s AS (SELECT floor(x / 8.0) AS sx, floor(y / 8.0) AS sy, count(*) FILTER (terrain IS NOT NULL AND visible) / nullif(CAST(count(terrain) AS DOUBLE), 0) AS ratio FROM v_cells GROUP BY 1, 2)
    SELECT round(avg(ratio), 6) AS visibility, count(ratio) AS sectors FROM s""")
def a3_visibility(v):
    return A.overall_visibility(v.cells, 8).withColumn("visibility", F.round("visibility", 6))


@query("SELECT CAST(floor(x / 8.0) AS INT) AS sx, CAST(floor(y / 8.0) AS INT) AS sy, round(sum(coalesce(amount, 0)), 2) AS amount FROM v_cells GROUP BY 1, 2")
def a4_amount_per_sector(v):
    return A.amount_per_sector(v.cells, 8).withColumn("amount", F.round("amount", 2))


@query("SELECT round(avg(CASE WHEN updated >= DATE '1995-01-01' THEN 1.0 ELSE 0.0 END), 6) AS fresh, count(*) AS cells FROM v_cells")
def a5_freshness(v):
    return A.freshness(v.cells, F.lit("1995-01-01").cast("date")).withColumn("fresh", F.round("fresh", 6))


@query("""SELECT owner, string_agg(stance || ':' || n, ', ' ORDER BY stance) AS line FROM (SELECT owner, stance, count(*) AS n FROM v_units GROUP BY 1, 2) GROUP BY owner""")
def a6_composition(v):
    return A.composition(v.units, "owner", "stance").select("owner", "line")


_ORDERS = """SELECT unit_id, stance AS order_type, CASE WHEN kind_id % 3 = 0 THEN kind_id % 5 END AS target_id, CASE WHEN kind_id % 3 <> 2 THEN x % 4 END AS px, CASE WHEN kind_id % 3 <> 2 THEN y % 4 END AS py FROM v_units"""


@query(f"""WITH o AS (SELECT unit_id, order_type, target_id, CASE WHEN target_id IS NULL THEN px END AS px, CASE WHEN target_id IS NULL THEN py END AS py FROM ({_ORDERS})),
    p AS (SELECT *, unit_id % CAST(ceil(count(*) OVER (PARTITION BY order_type, target_id, px, py) / 500.0) AS BIGINT) AS part FROM o)
    SELECT order_type, target_id, px, py, part, count(*) AS n, md5(string_agg(CAST(unit_id AS VARCHAR), ',' ORDER BY unit_id)) AS ids FROM p GROUP BY 1, 2, 3, 4, 5""")
def a7_batch_orders(v):
    at = lambda c: F.when(F.col("kind_id") % 3 != 2, F.col(c) % 4)
    orders = v.units.select("unit_id", F.col("stance").alias("order_type"), F.when(F.col("kind_id") % 3 == 0, F.col("kind_id") % 5).alias("target_id"), at("x").alias("px"), at("y").alias("py"))
    return A.batch_orders(orders, 500).select("order_type", "target_id", "px", "py", "part", F.size("unit_ids").cast("long").alias("n"), F.md5(F.array_join("unit_ids", ",")).alias("ids"))


@query("SELECT kind, event_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY value DESC, event_id) AS n FROM v_events WHERE value IS NOT NULL) WHERE n = 1")
def a8_arg_extreme(v):
    return A.arg_extreme(v.events.select("kind", "event_id", "key", "value"), ["kind"], "value", "event_id")


@query("SELECT key, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value, event_id) AS n FROM v_events) WHERE n = 1")
def a9_unique_by(v):
    return A.unique_by(v.events, ["key"], [F.col("value"), F.col("event_id")]).select("key", "event_id", "kind")


@query("""WITH c AS (SELECT owner, CAST(floor(avg(x) + 0.5) AS INT) AS cx, CAST(floor(avg(y) + 0.5) AS INT) AS cy FROM v_units GROUP BY owner)
    SELECT u.owner, cx, cy, round(max(sqrt((u.x - cx) * (u.x - cx) + (u.y - cy) * (u.y - cy))), 4) AS spread, count(*) AS n FROM v_units u JOIN c ON u.owner = c.owner GROUP BY 1, 2, 3""")
def a10_centroid_spread(v):
    return A.centroid_spread(v.units, "owner").withColumn("spread", F.round("spread", 4))


@query("""WITH r AS (SELECT y, min(x) AS lo, max(x) + 1 AS hi FROM v_cells WHERE visible GROUP BY y) SELECT CAST(floor(y / 8.0) AS INT) AS sy, CAST(floor(min(lo) / 8.0) AS INT) AS "first", CAST(ceil(max(hi) / 8.0) AS INT) AS "end" FROM r GROUP BY 1""")
def a11_row_bounds(v):
    return A.row_bounds(v.cells.filter("visible"), 8)


@query("""SELECT p.player FROM v_players p LEFT JOIN (SELECT owner, count(*) FILTER (k.primary_w = 3 AND u.hp > 48) + count(*) FILTER (k.cost > 2080) + count(*) FILTER (k.family = 'Brand#99') AS n FROM v_units u JOIN v_kinds k ON u.kind_id = k.kind_id GROUP BY owner) h
    ON p.player = h.owner WHERE coalesce(h.n, 0) = 0""")
def a12_eliminated(v):
    return A.eliminated(v.players, v.units, v.kinds, {"army": (F.col("primary_w") == 3) & (F.col("hp") > 48), "producers": F.col("cost") > 2080, "bases": F.col("family") == "Brand#99"})


@query("SELECT owner, stance, count(*) FILTER (zone = 'O') AS \"O\", count(*) FILTER (zone = 'F') AS \"F\" FROM v_units GROUP BY 1, 2")
def a13_assignment_pivot(v):
    return A.assignment_pivot(v.units, "owner", "stance", "zone", ["O", "F"])


@query("""WITH h AS (SELECT * FROM v_units WHERE kind_id % 40 = 1), r AS (SELECT * FROM v_units WHERE kind_id % 40 = 2), b AS (SELECT * FROM v_units WHERE kind_id % 40 = 3),
    o AS (SELECT b.owner, count(*) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.owner = b.owner AND r.x >= b.x - 8 AND r.x < b.x + 9 AND r.y >= b.y - 8 AND r.y < b.y + 9) GROUP BY 1),
    t AS (SELECT d.owner, coalesce((SELECT count(*) FROM h WHERE h.owner = d.owner), 0) AS h, coalesce((SELECT count(*) FROM r WHERE r.owner = d.owner), 0) AS r, coalesce(o.n, 0) AS o FROM (SELECT DISTINCT owner FROM b) d LEFT JOIN o ON d.owner = o.owner)
    SELECT owner, CAST(greatest(1, least(6, 2 * h * (o + 1))) AS BIGINT) AS cap, round(r / greatest(h / 2.0, 1.0) * CASE WHEN h < 2 THEN 3 WHEN h > r * 4 THEN 0 ELSE 1 END, 4) AS priority FROM t""")
def a14_capacity_plan(v):
    pick = lambda n: v.units.filter(F.col("kind_id") % 40 == n).select("unit_id", "owner", "x", "y")
    return A.capacity_plan(pick(1), pick(2), pick(3), 8).withColumn("priority", F.round("priority", 4))


# --- ranking and allocation ------------------------------------------------------------------


@query("""WITH a AS (SELECT request_id, item || requester AS item, priority, CAST(requester AS BIGINT) AS place FROM v_requests WHERE request_id % 3 = 0 UNION ALL SELECT request_id, item || requester, priority * 0.9, NULL FROM v_requests WHERE request_id % 3 = 1
      UNION ALL SELECT request_id, item || requester, priority * 1.1, NULL FROM v_requests WHERE request_id % 3 = 2)
    SELECT item, request_id, priority, place FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY priority DESC, request_id) AS n FROM a) WHERE n = 1""")
def w1_merge_requests(v):
    r = v.requests.withColumn("item", F.concat("item", F.col("requester").cast("string")))
    shape = lambda n, f: r.filter(F.col("request_id") % 3 == n).select("request_id", "item", (F.col("priority") * f).alias("priority"))
    first = r.filter("request_id % 3 = 0").select("request_id", "item", "priority", F.col("requester").alias("place"))
    return R.merge_requests(first, shape(1, 0.9), shape(2, 1.1)).select("item", "request_id", "priority", "place")


_W2 = """u AS (SELECT unit_id, kind_id % 50 AS item, x, y, CASE WHEN unit_id % 2 = 0 THEN CAST(owner AS BIGINT) END AS donor, CASE WHEN unit_id % 2 = 0 THEN hp END AS donor_priority, zone = 'F' AS combatant FROM v_units),
    q AS (SELECT kind_id % 50 AS item, min(owner) AS requester, CAST(30 AS DOUBLE) AS priority FROM v_units WHERE owner > 4 GROUP BY 1),
    g AS (SELECT player AS grab_id, player AS requester, CAST(player % 7 AS DOUBLE) AS priority, x, y, CAST(4 AS DOUBLE) AS radius FROM v_players)"""


@query(f"""WITH {_W2}, won AS (SELECT unit_id, requester FROM (SELECT u.unit_id, q.requester, row_number() OVER (PARTITION BY u.item ORDER BY coalesce(donor_priority, 0), unit_id) AS n FROM u JOIN q ON u.item = q.item
      WHERE donor IS NULL OR (donor <> q.requester AND coalesce(donor_priority, 0) < q.priority)) WHERE n = 1),
    free AS (SELECT * FROM u WHERE combatant AND donor IS NULL AND unit_id NOT IN (SELECT unit_id FROM won)),
    near AS (SELECT f.unit_id, g.requester, row_number() OVER (PARTITION BY f.unit_id ORDER BY g.priority DESC, g.grab_id) AS n FROM free f JOIN g ON (f.x - g.x) * (f.x - g.x) + (f.y - g.y) * (f.y - g.y) <= 16)
    SELECT unit_id, requester, 'request' AS method FROM won UNION ALL SELECT unit_id, requester, 'grab' FROM near WHERE n = 1""")
def w2_assign_free(v):
    even = F.col("unit_id") % 2 == 0
    units = v.units.select("unit_id", (F.col("kind_id") % 50).alias("item"), "x", "y", F.when(even, F.col("owner").cast("long")).alias("donor"), F.when(even, F.col("hp")).alias("donor_priority"), (F.col("zone") == "F").alias("combatant"))
    requests = v.units.filter("owner > 4").groupBy((F.col("kind_id") % 50).alias("item")).agg(F.min("owner").alias("requester"), F.lit(30.0).alias("priority"))
    grabs = v.players.select(F.col("player").alias("grab_id"), F.col("player").alias("requester"), (F.col("player") % 7).cast("double").alias("priority"), "x", "y", F.lit(4.0).alias("radius"))
    return R.assign_free(units, requests, grabs)


_W3 = """o AS (SELECT p.player, k.kind_id % 4 AS queue, k.kind_id AS item, k.cost FROM v_players p JOIN v_kinds k ON k.kind_id % 25 = p.player),
    r AS (SELECT kind_id % 25 AS player, kind_id AS item, CAST(kind_id % 17 AS DOUBLE) AS priority FROM v_kinds WHERE kind_id % 3 <> 0),
    q AS (SELECT player, CAST(n AS BIGINT) AS queue, CASE (player + n) % 3 WHEN 0 THEN 'idle' WHEN 1 THEN 'active' ELSE 'hold' END AS status, (SELECT min(item) FROM o WHERE o.player = v_players.player AND o.queue = n) AS current, CAST(player * 200 AS DOUBLE) AS credits FROM v_players CROSS JOIN (SELECT unnest(range(0, 4)) AS n))"""


@query(f"""WITH {_W3}, top AS (SELECT * FROM (SELECT o.player, o.queue, o.item, o.cost, r.priority, row_number() OVER (PARTITION BY o.player, o.queue ORDER BY r.priority DESC, o.item DESC) AS n FROM o JOIN r ON o.player = r.player AND o.item = r.item) WHERE n = 1),
    j AS (SELECT q.*, t.item AS decision, t.priority, c.priority AS cp, sum(coalesce(t.priority, 0)) OVER (PARTITION BY q.player) AS weight, sum(coalesce(t.cost, 0)) OVER (PARTITION BY q.player) AS cost FROM q LEFT JOIN top t ON q.player = t.player AND q.queue = t.queue LEFT JOIN r c ON c.player = q.player AND c.item = q.current)
    SELECT player, queue, decision, priority, weight, round(cost, 2) AS cost, CASE WHEN status = 'idle' AND decision IS NOT NULL THEN 'start' WHEN status = 'active' AND decision <> current AND priority > 2 * coalesce(cp, 0) THEN 'switch'
      WHEN status = 'active' AND decision = current AND cost > credits AND priority < 0.25 * weight THEN 'pause' WHEN status = 'hold' AND (credits >= cost OR priority >= 0.25 * weight) THEN 'resume' ELSE 'none' END AS action FROM j""")
def w3_queue_decisions(v):
    options = v.kinds.select((F.col("kind_id") % 25).cast("int").alias("player"), (F.col("kind_id") % 4).alias("queue"), F.col("kind_id").alias("item"), "cost")
    requests = v.kinds.filter("kind_id % 3 <> 0").select((F.col("kind_id") % 25).cast("int").alias("player"), F.col("kind_id").alias("item"), (F.col("kind_id") % 17).cast("double").alias("priority"))
    state = F.expr("CASE (player + queue) % 3 WHEN 0 THEN 'idle' WHEN 1 THEN 'active' ELSE 'hold' END")
    now = options.groupBy("player", "queue").agg(F.min("item").alias("current"))
    queues = v.players.select("player", (F.col("player") * 200).cast("double").alias("credits"), F.explode(F.expr("sequence(0L, 3L)")).alias("queue")).join(now, ["player", "queue"], "left").withColumn("status", state)
    return R.queue_decisions(options, requests, queues).withColumn("cost", F.round("cost", 2))


@query(f"""WITH s AS (SELECT CAST(floor(x / 8.0) AS INT) AS sx, CAST(floor(y / 8.0) AS INT) AS sy, count(*) FILTER (visible) / CAST(count(*) AS DOUBLE) AS ratio FROM v_cells GROUP BY 1, 2),
    r AS (SELECT sx, sy, (40 - sqrt((sx - 6) * (sx - 6) + (sy - 5) * (sy - 5))) * (1 - ratio) AS score FROM s WHERE abs(sx - 6) <= 5 AND abs(sy - 5) <= 5 AND ratio < 0.8
      UNION ALL SELECT CAST(floor(p.x / 8.0) AS INT), CAST(floor(p.y / 8.0) AS INT), 900.0 FROM v_players p JOIN v_cells c ON c.x = p.x AND c.y = p.y WHERE p.player <> {VIEWER} AND NOT c.visible)
    SELECT sx, sy, round(score, 4) AS score FROM r WHERE score > 0 ORDER BY r.score DESC, sx, sy LIMIT 25""")
def w4_scout_ranking(v):
    starts = J.unseen_starts(v.players, v.cells, F.col("player") == VIEWER).select(F.floor(F.col("x") / 8).cast("int").alias("sx"), F.floor(F.col("y") / 8).cast("int").alias("sy"))
    return R.scout_ranking(A.visibility(v.cells, 8), 6, 5, 5, 40.0, 25, starts).withColumn("score", F.round("score", 4))


@query("SELECT step, count(*) AS cells, step * 4 * 10 AS tick FROM (SELECT CAST(greatest(0, ceil((greatest(abs(x - 40), abs(y - 30)) - 5) / 4.0)) AS BIGINT) AS step FROM v_cells) GROUP BY 1")
def w5_ring_expansion(v):
    return R.ring_expansion(v.cells, 40, 30, 5, 4, 10)


@query("SELECT key, event_id, age FROM (SELECT key, event_id, CAST(row_number() OVER (PARTITION BY key ORDER BY tick DESC, event_id DESC) AS INT) AS age FROM v_events) WHERE age <= 5")
def w6_recent_rows(v):
    return R.recent_rows(v.events, "key", 5).select("key", "event_id", "age")


@query("""WITH b AS (SELECT player AS owner, x, y FROM v_players), f AS (SELECT * FROM v_cells WHERE NOT blocked),
    a AS (SELECT DISTINCT b.owner, f.cell_id, f.x, f.y FROM f JOIN b ON f.x >= b.x - 4 AND f.x < b.x + 7 AND f.y >= b.y - 4 AND f.y < b.y + 7),
    g AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.x >= b.x AND a.x < b.x + 3 AND a.y >= b.y AND a.y < b.y + 3))
    SELECT owner, cell_id, round(d, 4) AS distance FROM (SELECT *, sqrt((x - 64) * (x - 64) + (y - 50) * (y - 50)) AS d, row_number() OVER (PARTITION BY owner ORDER BY (x - 64) * (x - 64) + (y - 50) * (y - 50), cell_id) AS n FROM g) WHERE n = 1""")
def w7_closest_free_cell(v):
    return R.closest_free_cell(v.cells, v.players.select(F.col("player").alias("owner"), "x", "y"), 3, 4, 64, 50).withColumn("distance", F.round("distance", 4))


def _options(v):
    f = F.expr("CASE kind_id % 4 WHEN 0 THEN 'basic' WHEN 1 THEN 'power' WHEN 2 THEN 'threat' ELSE 'other' END")
    d = lambda e: F.expr(f"cast({e} as double)")
    return v.kinds.select(
        (F.col("kind_id") % 25).alias("player"), (F.col("kind_id") % 3).alias("queue"), F.col("kind_id").alias("item"), f.alias("family"), (F.col("kind_id") % 7).alias("owned"), (F.col("kind_id") % 9).alias("cap"),
        d("10 + kind_id % 5").alias("base"), d("kind_id % 100 * 20").alias("credits"), F.lit(1000.0).alias("credit_floor"), d("kind_id % 60").alias("power"), d("30").alias("drain"), d("kind_id % 13").alias("gain"), d("nullif(kind_id % 90, kind_id % 11)").alias("threat"), d("kind_id % 40").alias("strength"),
        "cost", (F.col("kind_id") % 5 + 1).alias("amount"),
    )


_W8 = """o AS (SELECT kind_id AS item, kind_id % 25 AS player, kind_id % 3 AS queue, kind_id % 7 AS owned, kind_id % 9 AS cap, 10.0 + kind_id % 5 AS base, kind_id % 100 * 20.0 AS credits, kind_id % 60 AS power, 30 AS drain, kind_id % 13 AS gain, CAST(nullif(kind_id % 90, kind_id % 11) AS DOUBLE) AS threat, CAST(kind_id % 40 AS DOUBLE) AS strength, cost, CAST(kind_id % 5 + 1 AS DOUBLE) AS amount FROM v_kinds),
    s AS (SELECT *, CAST(CASE item % 4 WHEN 0 THEN CASE WHEN owned >= cap THEN -100 WHEN credits < 1000 THEN base * (1 - owned / CAST(nullif(cap, 0) AS DOUBLE)) * credits / 1000.0 ELSE base * (1 - owned / CAST(nullif(cap, 0) AS DOUBLE)) END
      WHEN 1 THEN CASE WHEN power < drain THEN 100 WHEN power < drain + gain / 2.0 THEN 20 ELSE 0 END WHEN 2 THEN CASE WHEN owned >= cap THEN 0 WHEN threat IS NULL THEN base * (1 - owned / amount) * (strength / nullif(cost, 0) * 1000) WHEN threat > strength * CAST(1.1 AS DOUBLE) THEN base * threat / greatest(1.0, strength) ELSE 0 END ELSE -owned END AS DOUBLE) AS priority FROM o)"""


@query(f"""WITH {_W8} SELECT player, queue, item, round(priority, 4) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY player, queue ORDER BY priority DESC, item DESC) AS n FROM s
    WHERE priority > 0 AND owned < coalesce(CASE item % 4 WHEN 0 THEN CAST(cap AS DOUBLE) WHEN 2 THEN least(CAST(cap AS DOUBLE), 1 + floor(threat / greatest(1.0, strength))) END, 1e9)) WHERE n = 1""")
def w8_build_ranking(v):
    return R.build_ranking(_options(v), standard_rules(unknown_threat=True)).withColumn("priority", F.round("priority", 4))


@query("""WITH e AS (SELECT a.player AS viewer, b.player AS owner FROM v_players a JOIN v_players b ON a.team <> b.team AND b.is_combatant AND NOT b.is_neutral WHERE a.is_combatant),
    t AS (SELECT * FROM (SELECT owner, unit_id, x, y, CASE WHEN stance = 'R' AND zone = 'F' AND hp = 50 THEN 100000 WHEN stance = 'N' THEN max_hp * 10 ELSE max_hp END AS weight FROM v_units WHERE owner < 20 AND hp > 45) QUALIFY row_number() OVER (PARTITION BY owner ORDER BY weight DESC, unit_id) = 1),
    u AS (SELECT e.viewer, t.* FROM e JOIN t ON e.owner = t.owner QUALIFY row_number() OVER (PARTITION BY e.viewer ORDER BY t.weight DESC, t.unit_id) = 1),
    s AS (SELECT e.viewer, e.owner, p.x, p.y FROM e JOIN v_players p ON e.owner = p.player JOIN v_cells c ON c.x = p.x AND c.y = p.y AND NOT c.visible QUALIFY row_number() OVER (PARTITION BY e.viewer ORDER BY e.owner) = 1)
    SELECT p.player AS viewer, CASE WHEN u.viewer IS NOT NULL THEN 'unit' WHEN s.viewer IS NOT NULL THEN 'start' ELSE 'none' END AS kind, u.unit_id, coalesce(u.x, s.x) AS x, coalesce(u.y, s.y) AS y FROM v_players p LEFT JOIN u ON p.player = u.viewer LEFT JOIN s ON p.player = s.viewer""")
def w9_pick_target(v):
    a = v.players.filter("is_combatant").select(F.col("player").alias("viewer"), F.col("team").alias("vt"))
    enemies = a.join(v.players.filter("is_combatant and not is_neutral"), F.col("vt") != F.col("team")).select("viewer", F.col("player").alias("owner"))
    focus = (F.col("stance") == "R") & (F.col("zone") == "F") & (F.col("hp") == 50)
    starts = J.unseen_starts(v.players, v.cells, F.lit(False))
    return R.pick_target(v.units.filter("owner < 20 and hp > 45"), v.players.select(F.col("player").alias("viewer")), enemies, starts, focus, F.col("stance") == "N")


@query("""WITH s AS (SELECT family AS set_id, class AS item, count(*) AS w FROM v_kinds GROUP BY 1, 2), o AS (SELECT family AS set_id, class AS item, count(*) AS owned FROM v_kinds WHERE secondary_w IS NULL GROUP BY 1, 2),
    t AS (SELECT set_id, item, CAST(floor(40 * w / CAST(sum(w) OVER (PARTITION BY set_id) AS DOUBLE) + 0.5) AS BIGINT) AS target FROM s),
    m AS (SELECT set_id, item, target, greatest(target - coalesce(owned, 0), 0) AS missing FROM t LEFT JOIN o USING (set_id, item))
    SELECT set_id, item, target, missing, round(50.0 * missing / nullif(CAST(sum(missing) OVER (PARTITION BY set_id) AS DOUBLE), 0), 6) AS share FROM m""")
def w10_split_quota(v):
    sets = v.kinds.groupBy(F.col("family").alias("set_id"), "class").count().groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("class", "count"))).alias("members"))
    owned = v.kinds.filter("secondary_w is null").groupBy(F.col("family").alias("set_id"), F.col("class").alias("item")).agg(F.count("*").alias("owned"))
    return R.split_quota(sets, 40, 50.0, owned).withColumn("share", F.round("share", 6))


@query("SELECT kind, event_id FROM (SELECT kind, event_id, row_number() OVER (PARTITION BY kind ORDER BY md5(CAST(event_id AS VARCHAR) || 'seed'), event_id) AS n FROM v_events) WHERE n = 1")
def w11_seeded_pick(v):
    return R.seeded_pick(v.events.select("kind", "event_id"), "kind", "event_id", "seed")


# --- history -------------------------------------------------------------------------------------


@query("""SELECT event_id, coalesce(last_value(CASE WHEN value >= 60 THEN true WHEN value < 30 THEN false END IGNORE NULLS) OVER (PARTITION BY key ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING), false) AS active FROM v_events""")
def t1_hysteresis(v):
    return T.hysteresis(v.events, "key", "tick", "event_id", F.col("value") >= 60, F.col("value") >= 30).select("event_id", "active")


@query("""WITH s AS (SELECT *, 4 + key % 6 AS n, value AS spread FROM v_events) SELECT event_id, CASE WHEN coalesce(last_value(CASE WHEN spread <= sqrt(n) * 10 + 5 THEN true WHEN spread > sqrt(n) * 10 + 15 THEN false END IGNORE NULLS)
    OVER (PARTITION BY key ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING), false) THEN 'attack' ELSE 'gather' END AS phase FROM s""")
def t2_phase_by_spread(v):
    rows = v.events.withColumn("n", 4 + F.col("key") % 6).withColumn("spread", F.col("value"))
    return T.phase_by_spread(rows, "key", "tick", "event_id").select("event_id", "phase")


_KEPT = """WITH RECURSIVE r AS (SELECT key, tick, event_id, row_number() OVER (PARTITION BY key ORDER BY tick, event_id) AS n FROM v_events),
    w(key, n, last, kept, event_id) AS (SELECT key, n, tick, true, event_id FROM r WHERE n = 1 UNION ALL SELECT r.key, r.n, CASE WHEN r.tick - w.last >= 1440 THEN r.tick ELSE w.last END, r.tick - w.last >= 1440, r.event_id FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1)
    SELECT event_id, key{more} FROM w WHERE kept"""


@query(_KEPT.format(more=""))
def t3_cooldown(v):
    return T.cooldown(v.events, "key", "tick", "event_id", 1440).select("event_id", "key")


@query("""WITH b AS (SELECT kind, tick // 60 AS hour, max(value) AS own FROM v_events GROUP BY 1, 2),
    o AS (SELECT *, exp(max(ln(own + 4) - hour * ln(0.75)) OVER (PARTITION BY kind ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + hour * ln(0.75)) - 4 AS old FROM b)
    SELECT kind, hour, round(greatest(own, CASE WHEN old > 0.5 THEN old END) + 0.0000123, 3) AS value FROM o""")
def t4_decaying_max(v):
    rows = v.events.withColumn("hour", F.expr("tick div 60"))
    return T.decaying_max(rows, "kind", "hour", "value").withColumn("value", F.round(F.col("value") + 0.0000123, 3))


@query("""SELECT event_id, key, kind FROM (SELECT *, lag(kind) OVER w AS last, row_number() OVER w AS n FROM v_events WINDOW w AS (PARTITION BY key ORDER BY tick, event_id)) WHERE n = 1 OR kind IS DISTINCT FROM last""")
def t5_emit_on_change(v):
    return T.emit_on_change(v.events, "key", "tick", "event_id", ["kind"]).select("event_id", "key", "kind")


@query("""WITH b AS (SELECT *, min(value) OVER (PARTITION BY key ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM v_events),
    s AS (SELECT *, last_value(CASE WHEN value IS NOT NULL AND (best IS NULL OR value < best) THEN tick END IGNORE NULLS) OVER (PARTITION BY key ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING) AS since FROM b)
    SELECT event_id, coalesce(tick - since >= 4320, false) AS stalled FROM s""")
def t6_stalled(v):
    return T.stalled(v.events, "key", "tick", "event_id", "value", 4320).select("event_id", "stalled")


@query("""SELECT event_id, gap, CASE WHEN gap > 2880 THEN 'end' WHEN gap > 1440 THEN 'retarget' WHEN gap IS NOT NULL THEN 'keep' END AS stage FROM (SELECT event_id, lead(tick) OVER (PARTITION BY key ORDER BY tick, event_id) - tick AS gap FROM v_events)""")
def t7_idle_stages(v):
    return T.idle_stages(v.events, "key", "tick", "event_id", 1440, 2880).select("event_id", "gap", "stage")


@query("""WITH RECURSIVE i AS (SELECT *, sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING) AS island FROM v_events),
    n AS (SELECT key, island, tick, event_id, row_number() OVER (PARTITION BY key, island ORDER BY tick, event_id) AS n FROM i),
    w(key, island, n, last, size, event_id) AS (SELECT key, island, n, tick, 12, event_id FROM n WHERE n = 1 UNION ALL
      SELECT n.key, n.island, n.n, CASE WHEN n.tick > w.last + 240 THEN n.tick ELSE w.last END, CASE WHEN n.tick > w.last + 240 THEN w.size - 1 ELSE w.size END, n.event_id FROM w JOIN n ON n.key = w.key AND n.island = w.island AND n.n = w.n + 1)
    SELECT event_id, CAST(n - 1 AS INT) AS update_no, round(least(5.0 * pow(1.01, n - 1), 50.0), 6) AS priority, size AS requested, size < 6 AS ended FROM w""")
def t8_ramp(v):
    out = T.ramp(v.events, "key", "tick", "event_id", F.col("value") > 90, 5.0, 12, 6)
    return out.select("event_id", "update_no", F.round("priority", 6).alias("priority"), "requested", "ended")


@query("""WITH k AS (SELECT DISTINCT kind FROM v_events ORDER BY kind LIMIT 2), c AS (SELECT key, count(*) FILTER (kind = (SELECT min(kind) FROM k)) AS a, count(*) FILTER (kind = (SELECT max(kind) FROM k)) AS b FROM v_events WHERE kind IN (SELECT kind FROM k) GROUP BY key)
    SELECT key, a >= 3 OR b >= 3 AS excluded, a + 1 AS escort FROM c""")
def t9_retry_exclusion(v):
    reasons = [r[0] for r in v.events.select("kind").distinct().orderBy("kind").limit(2).collect()]
    return T.retry_exclusion(v.events.filter(F.col("kind").isin(reasons)), "key", "kind", reasons).select("key", "excluded", "escort")


@query("""SELECT key, round(sum(value * pow(0.5, k)), 6) AS level, count(*) AS n FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY tick DESC, event_id DESC) AS k FROM v_events) GROUP BY key""")
def t10_halving_mean(v):
    return T.halving_mean(v.events, "key", "tick", "event_id", "value").withColumn("level", F.round("level", 6))


_SPANS = """WITH r AS (SELECT *, lag(kind) OVER (PARTITION BY key ORDER BY tick, event_id) AS before FROM v_events WHERE kind IN ('click', 'purchase')),
    f AS (SELECT *, lead(tick) OVER w AS "end", lead(CASE WHEN value < 20 THEN 'cheap' WHEN value < 60 THEN 'usual' ELSE 'dear' END) OVER w AS reason
      FROM r WHERE (kind = 'click' AND (before IS NULL OR before = 'purchase')) OR (kind = 'purchase' AND before = 'click') WINDOW w AS (PARTITION BY key ORDER BY tick, event_id)),
    s AS (SELECT key, tick AS start, "end", "end" - tick AS duration, reason FROM f WHERE kind = 'click')"""


def _lifecycle(v) -> DataFrame:
    reason = F.when(F.col("value") < 20, "cheap").when(F.col("value") < 60, "usual").otherwise("dear")
    return T.group_lifecycle(v.events, "key", "tick", "event_id", "kind", "click", "purchase", reason)


@query(f"{_SPANS} SELECT * FROM s")
def t11_group_lifecycle(v):
    return _lifecycle(v)


@query(f'{_SPANS} SELECT reason, count(*) AS n, round(avg(duration), 4) AS mean_duration, max(duration) AS longest FROM s WHERE "end" IS NOT NULL GROUP BY reason')
def t11_lifecycle_by_reason(v):
    return T.lifecycle_by_reason(_lifecycle(v)).withColumn("mean_duration", F.round("mean_duration", 4))


@query("SELECT count(*) AS n, round(sum(value), 4) AS total, CAST(time_bucket(INTERVAL '6 hours', ts) AS VARCHAR) AS start FROM v_events GROUP BY 3")
def t12_per_period(v):
    out = T.per_period(v.events, "ts", "6 hours", [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return out.withColumn("start", F.col("start").cast("string"))


# --- grids -------------------------------------------------------------------------------------------

_DISTANCE = "d AS (SELECT c.cell_id, c.x, c.y, CAST(min(abs(c.x - b.x) + abs(c.y - b.y)) AS INT) AS d FROM v_cells c LEFT JOIN v_cells b ON b.blocked GROUP BY 1, 2, 3)"


@query(f"WITH {_DISTANCE} SELECT * FROM d")
def g1_distance_to_blocked(v):
    return G.distance_to_blocked(v.cells)


@query(f"WITH {_DISTANCE} SELECT * FROM d")
def g1_distance_over_gaps(v):
    return G.distance_over_gaps(v.cells)


@query(f"WITH {_DISTANCE}, s AS (SELECT * FROM d WHERE d >= 6) SELECT cell_id, d FROM s WHERE NOT EXISTS (SELECT 1 FROM s r WHERE (r.x - s.x) * (r.x - s.x) + (r.y - s.y) * (r.y - s.y) < 36 AND (r.d > s.d OR (r.d = s.d AND r.cell_id < s.cell_id)))")
def g2_clear_spots(v):
    return G.clear_spots(v.cells, 6).select("cell_id", "d")


def _sectors(v):
    s = A.amount_per_sector(v.cells, 8)
    return s.select((F.col("sx") + F.col("sy") * 65536).cast("long").alias("sector_id"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.floor(F.col("amount") / 1e6).cast("double").alias("threat"))


@query("""WITH s AS (SELECT CAST(floor(x / 8.0) AS INT) AS x, CAST(floor(y / 8.0) AS INT) AS y, CAST(floor(sum(coalesce(amount, 0)) / 1e6) AS DOUBLE) AS threat FROM v_cells GROUP BY 1, 2),
    n AS (SELECT a.x, a.y, b.x AS bx, b.y AS by, CASE WHEN a.x = b.x OR a.y = b.y THEN 1.0 ELSE 0.707 END AS w FROM s a JOIN s b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y)),
    base AS (SELECT s.x, s.y, s.threat + coalesce((SELECT sum(t.threat) FROM n JOIN s t ON t.x = n.bx AND t.y = n.by WHERE n.x = s.x AND n.y = s.y), 0) AS b FROM s),
    d1 AS (SELECT x, y, greatest(b, 0.0) AS d FROM base),
    d2 AS (SELECT base.x, base.y, greatest(base.b, coalesce((SELECT 0.95 * max(d1.d * n.w) FROM n JOIN d1 ON d1.x = n.bx AND d1.y = n.by WHERE n.x = base.x AND n.y = base.y), 0.0)) AS d FROM base),
    d3 AS (SELECT base.x, base.y, greatest(base.b, coalesce((SELECT 0.95 * max(d2.d * n.w) FROM n JOIN d2 ON d2.x = n.bx AND d2.y = n.by WHERE n.x = base.x AND n.y = base.y), 0.0)) AS d FROM base)
    SELECT CAST(x + y * 65536 AS BIGINT) AS sector_id, round(CAST(d AS DOUBLE), 4) AS d FROM d3""")
def g3_diffuse(v):
    s = _sectors(v)
    return G.diffuse(s, J.neighbours8(s, "sector_id"), 3).withColumn("d", F.round("d", 4))


@query("""SELECT c.cell_id, c.x, c.y FROM v_cells c JOIN v_cells o ON o.x BETWEEN c.x AND c.x + 2 AND o.y BETWEEN c.y AND c.y + 2 AND NOT o.blocked GROUP BY 1, 2, 3 HAVING count(*) = 9""")
def g4_clear_window(v):
    return G.clear_window(v.cells, 3)


@query("""WITH f AS (SELECT x, y, CAST(floor(x / 4.0) AS BIGINT) | (CAST(floor(y / 4.0) AS BIGINT) << 16) AS s FROM v_cells WHERE NOT (blocked OR cell_id % 3 = 0)),
    p AS (SELECT DISTINCT a.s, b.s AS o FROM f a JOIN f b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.s <> b.s) SELECT s AS sector_id, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS links FROM p GROUP BY s""")
def g5_sector_links(v):
    cells = v.cells.withColumn("blocked", F.col("blocked") | (F.col("cell_id") % 3 == 0))
    return G.sector_links(cells, 4).withColumn("links", F.array_join("links", ","))


@query(f"WITH RECURSIVE {REGIONS} SELECT cell_id, region FROM reg")
def g6_regions(v):
    return G.regions(walled(v.cells)).select("cell_id", "region")


# --- streams ---------------------------------------------------------------------------------------------

_LATE = "(SELECT max(ts) FROM v_events) - INTERVAL '10 minutes'"


def _stream(v):
    events = S.event_stream(v.spark, f"{v.sf_dir}/event[s].parquet").withColumnsRenamed({"user_id": "key", "event_type": "kind"})
    return events.withColumn("tick", F.expr("timestampdiff(MINUTE, TIMESTAMP '2024-01-01 00:00:00', ts)"))


def _run(v, stream):
    return ST.run_to_table(stream, shared_dir(v.spark))


def _closed(v, df, end):
    return ST.closed(df, end, event_time(v.events), "10 minutes")


@query(f"SELECT CAST(s AS VARCHAR) AS start, n, threat FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, count(*) AS n, round(sum(value), 4) AS threat FROM v_events GROUP BY 1) WHERE s + INTERVAL '1 hour' <= {_LATE}")
def r1_stream_threat(v):
    out = _run(v, ST.stream_threat(_stream(v), "1 hour"))
    return _closed(v, out, F.col("start") + F.expr("INTERVAL 1 HOUR")).select(F.col("start").cast("string").alias("start"), "n", F.round("threat", 4).alias("threat"))


_R2 = f"""SELECT CAST(s AS VARCHAR) AS start, keys FROM (SELECT b.s - INTERVAL '1 hour' * o.o AS s, count(DISTINCT key) AS keys FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, key FROM v_events) b CROSS JOIN (SELECT unnest(range(0, 3)) AS o) o GROUP BY 1) WHERE s + INTERVAL '3 hours' <= {_LATE}"""


@query(_R2)
def r2_stream_freshness(v):
    out = _run(v, ST.stream_freshness(_stream(v), "3 hours", "1 hour"))
    return _closed(v, out, F.col("start") + F.expr("INTERVAL 3 HOURS")).select(F.col("start").cast("string").alias("start"), "keys")


@query(f"SELECT start, keys, true AS near FROM ({_R2})")
def r2_stream_freshness_sketched(v):
    """The sketched counts beside those of the batch twin, which they may miss by the sketch's stated error."""
    out = _run(v, ST.stream_freshness_sketched(_stream(v), "3 hours", "1 hour"))
    windows = event_time(v.events).groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count_distinct("key").alias("exact")).select(F.col("w.start").alias("start"), "exact")
    both = _closed(v, out, F.col("start") + F.expr("INTERVAL 3 HOURS")).join(windows, "start")
    near = F.abs(F.col("keys") - F.col("exact")) <= F.greatest(F.col("exact") * ST.sketch_error(12), F.lit(1))
    return both.select(F.col("start").cast("string").alias("start"), F.col("exact").alias("keys"), near.alias("near"))


@query(f"""WITH g AS (SELECT key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS new FROM v_events),
    s AS (SELECT key, ts, sum(new) OVER (PARTITION BY key ORDER BY ts) AS i FROM g) SELECT key, CAST(a AS VARCHAR) AS start, n FROM (SELECT key, min(ts) AS a, max(ts) + INTERVAL '12 hours' AS b, count(*) AS n FROM s GROUP BY key, i) WHERE b <= {_LATE}""")
def r3_stream_sessions(v):
    out = _run(v, ST.stream_sessions(_stream(v), "12 hours"))
    return _closed(v, out, F.col("end")).select("key", F.col("start").cast("string").alias("start"), "n")


@query("SELECT DISTINCT key, kind FROM v_events")
def r4_stream_unique(v):
    return _run(v, ST.stream_unique(_stream(v), ["key", "kind"], "60 days").select("key", "kind"))


@query("""SELECT event_id, key, kind FROM (SELECT *, lag(kind) OVER w AS last, row_number() OVER w AS n FROM v_events WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)) WHERE n = 1 OR kind IS DISTINCT FROM last""")
def r5_stream_on_change(v):
    return _run(v, ST.stream_on_change(_stream(v)))


@query(_KEPT.format(more=", last AS tick"))
def r6_stream_cooldown(v):
    return _run(v, ST.stream_cooldown(_stream(v), 1440))


@query("""WITH e AS (SELECT event_id, key, tick // 1440 AS day, tick, value FROM v_events),
    o AS (SELECT *, max(value) OVER (PARTITION BY key, day ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING) AS own,
      exp(max(ln(value + 4) - day * ln(0.75)) OVER (PARTITION BY key ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + day * ln(0.75)) - 4 AS old FROM e)
    SELECT event_id, key, round(greatest(own, CASE WHEN old > 0.5 THEN old END) + 0.0000123, 3) AS value FROM o""")
def r7_stream_decaying_max(v):
    return _run(v, ST.stream_decaying_max(_stream(v), 1440)).withColumn("value", F.round(F.col("value") + 0.0000123, 3))


@query("""SELECT event_id, key, coalesce(last_value(CASE WHEN value >= 60 THEN true WHEN value < 30 THEN false END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS active FROM v_events""")
def r8_stream_hysteresis(v):
    return _run(v, ST.stream_hysteresis(_stream(v), 60, 30))


def _passed(v, out):
    """Rows of events that the watermark has passed; of the others an ordered stream has emitted none."""
    return out.join(event_time(v.events).select("event_id", "ts"), "event_id").crossJoin(F.broadcast(event_time(v.events).agg((F.max("ts") - F.expr("INTERVAL 10 MINUTES")).alias("b")))).filter("ts <= b").drop("ts", "b")


@query(f"""SELECT event_id, key, kind FROM (SELECT *, lag(kind) OVER w AS last, row_number() OVER w AS n FROM v_events WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)) WHERE (n = 1 OR kind IS DISTINCT FROM last) AND ts <= {_LATE}""")
def r5_stream_on_change_ordered(v):
    return _passed(v, _run(v, ST.stream_on_change(_stream(v), "10 minutes")))


@query(_KEPT.format(more=", last AS tick") + f" AND event_id IN (SELECT event_id FROM v_events WHERE ts <= {_LATE})")
def r6_stream_cooldown_ordered(v):
    return _passed(v, _run(v, ST.stream_cooldown(_stream(v), 1440, "10 minutes", forget=dt.timedelta(minutes=1440))))


@query(f"""SELECT event_id, key, active FROM (SELECT event_id, key, ts, coalesce(last_value(CASE WHEN value >= 60 THEN true WHEN value < 30 THEN false END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS active FROM v_events) WHERE ts <= {_LATE}""")
def r8_stream_hysteresis_ordered(v):
    return _passed(v, _run(v, ST.stream_hysteresis(_stream(v), 60, 30, "10 minutes")))


@query("SELECT e.event_id, e.kind, k.first_kind FROM v_events e LEFT JOIN (SELECT kind, min(event_id) AS first_kind FROM v_events WHERE kind <> 'click' GROUP BY kind) k ON e.kind = k.kind")
def r9_stream_enrich(v):
    kinds = v.events.filter("kind <> 'click'").groupBy("kind").agg(F.min("event_id").alias("first_kind"))
    return _run(v, ST.stream_enrich(_stream(v), kinds).select("event_id", "kind", "first_kind"))


@query("""SELECT r.event_id AS request_id, r.kind AS item FROM v_events r WHERE NOT EXISTS (SELECT 1 FROM v_events c WHERE c.key % 20 = 7 AND c.kind = r.kind AND c.ts >= r.ts AND c.ts <= r.ts + INTERVAL '2 hours') AND r.ts + INTERVAL '2 hours' < (SELECT max(ts) FROM v_events WHERE key % 20 = 7) - INTERVAL '10 minutes'""")
def r10_stream_expired(v):
    requests = _stream(v).select(F.col("event_id").alias("request_id"), F.col("kind").alias("item"), "ts")
    claims = _stream(v).filter("key % 20 = 7").select(F.col("kind").alias("c_item"), F.col("ts").alias("c_ts"))
    out = _run(v, ST.stream_expired(requests, claims, "2 hours"))
    bound = event_time(v.events).filter("key % 20 = 7").agg((F.max("ts") - F.expr("INTERVAL 10 MINUTES")).alias("b"))
    return out.crossJoin(F.broadcast(bound)).filter(F.col("ts") + F.expr("INTERVAL 2 HOURS") < F.col("b")).select("request_id", "item")


# --- extension surface ---------------------------------------------------------------------------------------


@query(f"""WITH {_W8}, p AS (SELECT s.*, v.x AS base_x, v.y AS base_y, (v.x + 40) % 128 AS front_x, (v.y + 30) % 100 AS front_y FROM s JOIN v_players v USING (player))
    SELECT item, round(CASE WHEN item % 4 = 3 THEN 7.0 ELSE priority END, 4) AS priority,
      CASE item % 4 WHEN 0 THEN CAST(cap AS BIGINT) WHEN 2 THEN CAST(least(cap, 1 + floor(threat / greatest(1.0, strength))) AS BIGINT) END AS max_count,
      CAST(CASE WHEN item % 4 = 2 THEN floor(base_x + (front_x - base_x) / 4.0 + 0.5) ELSE base_x END AS INT) AS place_x,
      CAST(CASE WHEN item % 4 = 2 THEN floor(base_y + (front_y - base_y) / 4.0 + 0.5) ELSE base_y END AS INT) AS place_y FROM p""")
def x1_rule_book(v):
    book = standard_rules(unknown_threat=True).register("other", lambda: F.lit(7.0))
    options = _options(v)
    parameters = ("family", "base", "cap", "credit_floor")  # these come from a table of rules by item
    players = v.players.select("player", F.col("x").alias("base_x"), F.col("y").alias("base_y"), F.expr("(x + 40) % 128").alias("front_x"), F.expr("(y + 30) % 100").alias("front_y"))
    rows = with_parameters(options.drop(*parameters), options.filter("family <> 'other'").select("item", *parameters)).join(players, "player")
    place = book.placement()
    return rows.select("item", F.round(book.priority(), 4).alias("priority"), book.max_count().alias("max_count"), place["x"].cast("int").alias("place_x"), place["y"].cast("int").alias("place_y"))


@query("SELECT unit_id FROM v_units u JOIN v_kinds k ON u.kind_id = k.kind_id WHERE u.owner = 3 AND k.primary_w IS NULL AND k.cost < 1500")
def x2_predicates(v):
    return S.scan_units(v.units, v.players, v.kinds, VIEWER, "self", F.col("primary_w").isNull() & (F.col("cost") < 1500)).select("unit_id")
