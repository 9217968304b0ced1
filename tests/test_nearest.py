"""The nearest join against all pairs: clusters, sparse places, ties, odd numbers; and how many pairs it makes."""

from __future__ import annotations

import math
import random

import pytest

from tickgrid.operators import joins as J


def _want(a, b):
    ok = lambda x, y: x is not None and y is not None and math.isfinite(x) and math.isfinite(y)
    b = [(i, x, y) for i, x, y in b if ok(x, y)]
    if not b:
        return []
    return sorted((i, *min((math.sqrt((x - bx) * (x - bx) + (y - by) * (y - by)), j) for j, bx, by in b)[::-1]) for i, x, y in a if ok(x, y))


def _got(spark, a, b, r, **options):
    left, right = spark.createDataFrame(a, "a long, x double, y double"), spark.createDataFrame(b, "b long, x double, y double")
    return sorted((row.a, row.b, row.distance) for row in J.nearest(left, right, "a", "b", r, **options).collect())


def _clusters(seed, n):
    rnd = random.Random(seed)
    centres = [(rnd.uniform(-1e5, 1e5), rnd.uniform(-1e5, 1e5), 10 ** rnd.uniform(-3, 4)) for _ in range(5)]
    return [(i, cx + rnd.gauss(0, s), cy + rnd.gauss(0, s)) for i in range(n) for cx, cy, s in [rnd.choice(centres)]]


@pytest.mark.parametrize("r", [0.5, 300.0])
def test_clusters_by_all_pairs(spark, r):
    a, b = _clusters(1, 300), _clusters(2, 400) + [(900 + i, 3e5, -2e5 + i % 3) for i in range(9)]
    assert _got(spark, a, b, r) == _want(a, b)


def test_odd_places_end(spark):
    nan, inf = float("nan"), float("inf")
    a = [(1, nan, 0.0), (2, 0.0, 0.0), (3, None, 1.0), (4, inf, 0.0), (5, -1e9, 1e9), (5, 2.0, 2.0)]
    b = [(7, nan, nan), (8, 3.0, 4.0), (6, 3.0, 4.0), (9, 4.0, 3.0), (10, 0.0, -inf), (11, None, None)]
    assert _got(spark, a, b, 4.0) == _want(a, b) and (2, 6, 5.0) in _want(a, b)
    assert _got(spark, a, b[:1], 4.0) == [] == _got(spark, a[:1], b, 4.0)
    close = [(i, 1.0 + i * 2**-52, 1.0) for i in range(40)]  # as close as doubles are
    assert _got(spark, a, close, 1e6, leaf=2) == _want(a, close)


def test_pairs_grow_with_points(spark):
    """Half of both sides in one spot, the rest scattered: cells and places met by a place do not grow with the table."""
    met = []
    for n in (400, 3_200):
        rnd = random.Random(n)
        spot = lambda i: (i, rnd.gauss(0, 1), rnd.gauss(0, 1)) if i % 2 else (i, rnd.uniform(-1e4, 1e4), rnd.uniform(-1e4, 1e4))  # noqa: E731,B023
        a, b = (spark.createDataFrame([spot(i) for i in range(n)], f"{name} long, x double, y double") for name in "ab")
        levels, cells, top = J.pyramid(b.withColumnRenamed("b", "id").select("x", "y", "id"), "id", 50.0)
        front = J._descend(a.select("x", "y").distinct(), levels, top)
        met.append(front.join(cells.select("gx", "gy"), ["gx", "gy"]).count() / n)
    assert max(met) <= 60 and met[1] <= 1.5 * met[0]
