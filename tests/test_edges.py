"""Small tables by hand: empty grids, ties, nulls, bounds, and rewrites against plain folds."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tickgrid.operators import aggregates as A
from tickgrid.operators import grid as G
from tickgrid.operators import joins as J
from tickgrid.operators import temporal as T
from tickgrid.operators.rules import RuleBook, standard_rules

CELLS = "cell_id long, x int, y int, blocked boolean"


def _grid(spark, rows: list[str]):
    cells = [(i, x, y, c == "#") for i, (x, y, c) in enumerate((x, y, c) for y, r in enumerate(rows) for x, c in enumerate(r))]
    return spark.createDataFrame(cells, CELLS)


def test_distance_on_ragged_grid(spark):
    rows = ["....#", ".....", "..#..", "#.."]
    blocked = [(x, y) for y, r in enumerate(rows) for x, c in enumerate(r) if c == "#"]
    got = {(r.x, r.y): r.d for r in G.distance_to_blocked(_grid(spark, rows)).collect()}
    assert got == {(x, y): min(abs(x - a) + abs(y - b) for a, b in blocked) for y, r in enumerate(rows) for x in range(len(r))}


def test_distance_without_blocked_or_cells(spark):
    assert {r.d for r in G.distance_to_blocked(_grid(spark, ["..", ".."])).collect()} == {None}
    assert G.distance_to_blocked(spark.createDataFrame([], CELLS)).count() == 0


def test_regions_follow_turns(spark):
    rows = [".#...", ".#.#.", "...#.", "####.", "....."]
    got = {r.cell_id: r.region for r in G.regions(_grid(spark, rows)).collect()}
    assert set(got.values()) == {0} and len(got) == 17
    split = {r.region for r in G.regions(_grid(spark, ["..", "##", ".."])).collect()}
    assert split == {0, 4}


def test_clear_window_needs_whole_squares(spark):
    got = [(r.x, r.y) for r in G.clear_window(_grid(spark, ["...", "...", "..#"]), 2).collect()]
    assert sorted(got) == [(0, 0), (0, 1), (1, 0)]


def test_radius_is_inclusive_and_negative_places_work(spark):
    a = spark.createDataFrame([(1, -3, -4)], "a long, x int, y int")
    b = spark.createDataFrame([(7, 0, 0), (8, 1, 0)], "b long, x int, y int")
    assert [(r.b, r.distance) for r in J.radius_join(a, b, 5).collect()] == [(7, 5.0)]


def test_nearest_breaks_ties_by_id(spark):
    a = spark.createDataFrame([(1, 0, 0)], "a long, x int, y int")
    b = spark.createDataFrame([(9, 0, 40), (8, 40, 0)], "b long, x int, y int")
    assert [(r.b, r.distance) for r in J.nearest(a, b, "a", "b", 2).collect()] == [(8, 40.0)]


def test_unarmed_attacker_gives_no_row(spark):
    att = spark.createDataFrame([(1, 1, 0, 0, 5.0, False, False)], "squad long, unit_id long, x int, y int, reach double, anti_air boolean, anti_ground boolean")
    tgt = spark.createDataFrame([(3, 1, 1, True)], "target_id long, x int, y int, airborne boolean")
    assert J.best_target(att, tgt, 10).count() == 0


def test_arg_extreme_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 4, None)], "g string, id long, v double")
    assert [(r.g, r.id) for r in A.arg_extreme(df, ["g"], "v", "id").collect()] == [("a", 2)]


def _history(n: int = 400):
    r = random.Random(7)
    return sorted((r.randrange(3), r.randrange(500), i, float(r.randrange(1, 100))) for i in range(n))


def test_cooldown_equals_fold(spark):
    rows = _history()
    df = spark.createDataFrame(rows, "key long, tick long, id long, v double")
    for strict in (False, True):
        kept, last = [], {}
        for key, tick, i, _ in rows:
            if key not in last or (tick - last[key] > 9 if strict else tick - last[key] >= 9):
                last[key] = tick
                kept.append(i)
        assert sorted(r.id for r in T.cooldown(df, "key", "tick", "id", 9, strict).collect()) == sorted(kept)


def test_decaying_max_equals_fold(spark):
    rows = _history()
    df = spark.createDataFrame([(k, t // 10, i, v) for k, t, i, v in rows], "key long, step long, id long, v double")
    want = {}
    for key in {r[0] for r in rows}:
        now = None
        for step in range(50):
            now = None if now is None or now * 0.75 - 1 <= 0.5 else now * 0.75 - 1
            own = [v for k, t, _, v in rows if k == key and t // 10 == step]
            if own:
                now = max(own + ([now] if now is not None else []))
                want[key, step] = round(now, 6)
    assert {(r.key, r.step): round(r.value, 6) for r in T.decaying_max(df, "key", "step", "v").collect()} == want


def test_halving_mean_equals_fold(spark):
    rows = _history()
    level: dict = {}
    for k, _, _, v in rows:
        level[k] = level.get(k, 0) + (v - level.get(k, 0)) / 2
    df = spark.createDataFrame(rows, "key long, tick long, id long, v double")
    assert {r.key: round(r.level, 6) for r in T.halving_mean(df, "key", "tick", "id", "v").collect()} == {k: round(v, 6) for k, v in level.items()}


def test_rule_book_falls_back(spark):
    df = spark.createDataFrame([("a", 2), ("b", 3)], "family string, owned int")
    book = RuleBook().register("a", lambda: F.lit(9.0))
    assert sorted(tuple(r) for r in df.select("family", book.priority()).collect()) == [("a", 9.0), ("b", -3.0)]


def test_bad_health_counts_nothing(spark):
    from tickgrid.functions.expr import firepower

    rows = [(1, None, None), (2, 0.0, 0.0), (3, 10.0, None), (4, 5.0, 10.0)]
    df = spark.createDataFrame(rows, "id int, hp double, max_hp double")
    one = F.lit(1.0)
    got = [r[0] for r in df.orderBy("id").select(firepower(F.col("hp"), F.col("max_hp"), [(F.lit(9.0), F.lit(3.0), one)])).collect()]
    assert got == [0.0, 0.0, 200.0, 10.0]


def test_all_blocked_and_far_points(spark):
    cells = spark.createDataFrame([(i, i % 5, i // 5, True) for i in range(25)], "cell_id long, x int, y int, blocked boolean")
    assert {r.d for r in G.distance_to_blocked(cells).collect()} == {0}
    free = cells.withColumn("blocked", F.lit(False))
    assert {r.d for r in G.distance_to_blocked(free).collect()} == {None}
    assert G.distance_to_blocked(cells.limit(0)).count() == 0 and G.clear_spots(cells, 2).count() == 0
    a = spark.createDataFrame([(1, 0, 0), (2, 1_000_000, 0), (3, None, 0)], "a long, x int, y int")
    b = spark.createDataFrame([(7, 3, 4)], "b long, x int, y int")
    assert [(r.a, r.b, round(r.distance)) for r in J.nearest(a, b, "a", "b", 2).orderBy("a").collect()] == [(1, 7, 5), (2, 7, 999997)]
    assert J.nearest(a, b.limit(0), "a", "b", 2).count() == 0


def test_full_and_over_cap(spark):
    book = standard_rules()
    rows = [(1, "basic", 3, 3), (2, "basic", 4, 3), (3, "basic", 0, 0), (4, "none", 2, 9)]
    df = spark.createDataFrame(rows, "item int, family string, owned int, cap int").withColumns({c: F.lit(10.0) for c in ("base", "credits", "credit_floor", "power", "drain", "gain", "threat", "strength")})
    df = df.withColumns({c: F.lit(4) for c in ("base_x", "base_y", "front_x", "front_y")})
    got = df.select("item", book.priority().alias("p"), book.max_count().alias("m")).orderBy("item").collect()
    assert [(r.p, r.m) for r in got] == [(-100.0, 3), (-100.0, 3), (-100.0, 0), (-2.0, None)]


def test_equal_times_go_by_id(spark):
    rows = [(i, 1, 5, k) for i, k in enumerate("aabba")]
    df = spark.createDataFrame(rows, "event_id long, key long, tick long, kind string")
    assert [r.event_id for r in T.emit_on_change(df, "key", "tick", "event_id", ["kind"]).orderBy("event_id").collect()] == [0, 2, 4]
    assert [r.event_id for r in T.cooldown(df, "key", "tick", "event_id", 1).collect()] == [0]


def test_orders_come_in_bounded_parts(spark):
    df = spark.range(1000).select(F.col("id").alias("unit_id"), F.lit("move").alias("order_type"), F.lit(None).cast("long").alias("target_id"), F.lit(1).alias("px"), F.lit(None).cast("int").alias("py"))
    got = A.batch_orders(df, 100).collect()
    assert sorted(r.part for r in got) == list(range(10)) and sorted(i for r in got for i in r.unit_ids) == list(range(1000)) and max(len(r.unit_ids) for r in got) == 100


def test_viewers_that_are_no_players(spark):
    from tickgrid.sources.tables import scan_units

    units = spark.createDataFrame([(i, owner, 1) for i, owner in enumerate([1, 2, 3, 9, None])], "unit_id long, owner int, kind_id long")
    players = spark.createDataFrame([(1, 1, True, False), (2, 1, True, False), (3, 2, True, False), (4, 1, True, True)], "player int, team int, is_combatant boolean, is_neutral boolean")
    seen = lambda viewer, relation: sorted(r.unit_id for r in scan_units(units, players, None, viewer, relation).collect())
    assert [seen(1, r) for r in ("self", "ally", "enemy", "hostile")] == [[0], [1], [2], [2, 3, 4]]
    assert [seen(9, r) for r in ("self", "ally", "enemy", "hostile")] == [[3], [], [0, 1, 2], [0, 1, 2, 4]]


def test_ranking_keeps_caps_and_falls_back(spark):
    from tickgrid.operators.ranking import build_ranking

    names = "item int, owned int, cap int, threat double, cost double, amount int"
    rows = [(1, 3, 3, 90.0, 500.0, 4), (2, 1, 3, None, 500.0, 4), (3, 4, 9, None, 500.0, 4), (4, 1, 9, 25.0, 500.0, 4), (5, 0, 9, 5.0, 500.0, 4)]
    df = spark.createDataFrame(rows, names).withColumns({"family": F.lit("threat"), "base": F.lit(10.0), "strength": F.lit(10.0), "player": F.lit(1), "queue": F.col("item")})
    df = df.withColumns({c: F.lit(1.0) for c in ("credits", "credit_floor", "power", "drain", "gain")}).withColumns({c: F.lit(4) for c in ("base_x", "base_y", "front_x", "front_y")})
    got = build_ranking(df, standard_rules(unknown_threat=True)).collect()
    # 1 is at its cap, 3 has all it needs, 5 faces no threat; 2 goes by strength and cost, 4 by the threat.
    assert {r.item: r.priority for r in got} == {2: 150.0, 4: 25.0}


def test_a_radius_that_does_not_grow(spark):
    points = spark.createDataFrame([(1, 0, 0), (2, 9, 0)], "point_id long, x int, y int")
    got = J.growing_radius_alert(points, spark.createDataFrame([(3, 0)], "x int, y int"), 3.0, 0.0, 2)
    assert sorted(map(tuple, got.collect())) == [(0, 1), (1, 1), (2, 1)]
