"""Tiled spatial joins: the rows of the plain ones, and no key with more rows than asked for."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tickgrid.operators import joins as J

MOST = 40


def _crowded(spark, name, n, seed):
    """A tenth of the points in one bucket, some of them in one place, the rest scattered; and rows without a place."""
    rnd = random.Random(seed)
    spots = [(50.5, 50.5) if i % 30 == 0 else (rnd.uniform(48, 60), rnd.uniform(48, 60)) if i % 10 == 0 else (rnd.uniform(-500, 500), rnd.uniform(-500, 500)) for i in range(n)]
    rows = [(i, i % 3, x, y) for i, (x, y) in enumerate(spots)] + [(n, 0, None, 1.0), (n + 1, 0, float("nan"), 1.0)]
    return spark.createDataFrame(rows, f"{name} long, team long, x double, y double")


def test_tiled_radius_join(spark):
    a, b = _crowded(spark, "a", 3_000, 1), _crowded(spark, "b", 2_000, 2)
    pairs = lambda df: sorted(map(tuple, df.select("a", "b", "distance").collect()))
    b_plain = b.drop("team")
    want = pairs(J.radius_join(a.filter("x = x"), b_plain.filter("x = x"), 12.0))
    assert pairs(J.radius_join_tiled(a, b_plain, 12.0, most=MOST)) == want and len(want) > 30_000
    same = pairs(J.radius_join(a.filter("x = x"), b.filter("x = x"), 12.0, on=("team",)))
    assert pairs(J.radius_join_tiled(a, b, 12.0, on=("team",), most=MOST)) == same
    left, right = (J._tiled(df, 12.0, MOST) for df in (a, b_plain))
    assert max(r["count"] for df in (left, right) for r in df.groupBy("__tile").count().collect()) <= MOST + 4  # parts go by row number, not exactly evenly
    every = left.select("__tile").distinct().count() * right.select("__tile").distinct().count()
    assert J._tile_pairs(left, right, 12.0).count() < every / 20
    assert J.radius_join_tiled(a.limit(0), b_plain, 12.0).count() == 0


def test_tiled_box_join(spark):
    a = _crowded(spark, "a", 3_000, 3)
    rnd = random.Random(4)
    corner = lambda i: rnd.uniform(45, 55) if i % 2 else rnd.uniform(-500, 480)
    boxes = spark.createDataFrame([(i, x, y, x + rnd.uniform(-1, 30), y + rnd.uniform(0, 30)) for i in range(300) for x, y in [(corner(i), corner(i))]], "box long, x0 double, y0 double, x1 double, y1 double")
    boxes = boxes.select("box", *[F.floor(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    pairs = lambda df: sorted(map(tuple, df.select("a", "box").collect()))
    want = pairs(J.box_join(a.filter("x = x"), boxes, 13))
    assert pairs(J.box_join_tiled(a, boxes, 13, most=MOST)) == want and len(want) > 10_000
