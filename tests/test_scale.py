"""What grows with the table: frames, broadcasts, pairs, rounds and errors, on tables just large enough to tell."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tickgrid.operators import grid as G
from tickgrid.operators import joins as J
from tickgrid.streaming import operators as ST

CELLS = "cell_id long, x int, y int, blocked boolean"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_distance_frame_looks_ahead_to_the_end(spark):
    """Such a frame is evaluated anew for each row: a column of 70,000 cells took 2.5 thousand million steps."""
    cells = spark.range(400).selectExpr("id cell_id", "cast(id % 4 as int) x", "cast(id div 4 as int) y", "id % 37 = 0 blocked")
    assert "unboundedfollowing$" not in _plan(G.distance_to_blocked(cells)).lower()


def test_cells_are_never_broadcast(spark):
    cells = spark.range(400).selectExpr("id cell_id", "cast(id % 20 as int) x", "cast(id div 20 as int) y", "id % 37 = 0 blocked")
    labels = cells.selectExpr("x", "y", "0 region")
    for df in (J.neighbours8(cells), J.touching(cells, labels, "cell_id"), J.standing(cells, labels, "cell_id")):
        df.collect()
        assert "Broadcast" not in _plan(df)


def test_reachable_pairs_are_distinct_also_for_a_of_two_regions(spark):
    labels = spark.createDataFrame([(0, 0, 5), (0, 2, 7), (9, 9, 8)], "x int, y int, region int")
    a = spark.createDataFrame([(1, 0, 0), (1, 0, 2), (2, 0, 0), (2, 0, 0), (3, 4, 4)], "a long, x int, y int")
    b = spark.createDataFrame([(10, 0, 1), (11, 1, 3), (12, 9, 9), (13, None, 1)], "b long, x int, y int")
    got = sorted(map(tuple, J.reachable(a, b, labels, "a", "b").collect()))
    assert got == [(1, 10), (1, 11), (2, 10)]


def test_nearest_goes_down_by_cells_not_by_places(spark, monkeypatch):
    asked = []
    descend = J._descend
    monkeypatch.setattr(J, "_descend", lambda a, *more: asked.append(a.count()) or descend(a, *more))
    cells = spark.createDataFrame([(i, i % 60, i // 60, i % 97 == 0) for i in range(3600)], CELLS)
    assert sorted(map(tuple, G.distance_over_gaps(cells).collect())) == sorted(map(tuple, G.distance_to_blocked(cells).collect()))
    assert asked[0] * 20 < 3600


def test_rounds_contract_a_chain_with_rising_numbers(spark, monkeypatch):
    made = []
    written = G.written
    monkeypatch.setattr(G, "written", lambda df, name: (lambda out: made.append(out.count()) or out)(written(df, name)))
    n = 3000
    nodes = spark.range(n + 1).withColumnRenamed("id", "node")
    touch = spark.range(n - 1).select(F.col("id").alias("node"), (F.col("id") + 1).alias("other"))
    assert {r.node: r.label for r in G._spread(nodes, touch).collect()} == {**dict.fromkeys(range(n), 0), n: n}
    assert sum(made) < 16 * n


def test_expiry_makes_no_pairs(spark):
    plan = _plan_of_stream(spark)
    assert "Join" not in plan


def _plan_of_stream(spark):
    rate = spark.readStream.format("rate").load()
    asked = rate.select(F.col("value").alias("request_id"), F.lit("a").alias("item"), F.col("timestamp").alias("ts"))
    claims = rate.select(F.lit("a").alias("c_item"), F.col("timestamp").alias("c_ts"))
    return ST.stream_expired(asked, claims, "2 hours")._jdf.queryExecution().analyzed().toString()


def test_sketches_of_many_windows_stay_within_the_error(spark):
    """Over hundreds of windows three standard errors are passed now and then; half the stated error is the sketches' three, so that all of it is safe."""
    start = dt.datetime(2024, 1, 1)
    rows = spark.range(900 * 2000).select(F.col("id").alias("key"), (F.lit(start).cast("timestamp") + F.make_dt_interval(hours=F.expr("cast(id div 2000 as int)"))).alias("ts"))
    inside = F.col("start").between(F.lit(start), F.lit(start + dt.timedelta(hours=898)))
    worst = lambda **size: ST.stream_freshness_sketched(rows, "2 hours", "1 hour", **size).filter(inside).agg(F.max(F.abs(F.col("keys") - 4000))).first()[0]
    assert worst() <= ST.sketch_error(12) / 2 * 4000 < worst(lg_size=12)
