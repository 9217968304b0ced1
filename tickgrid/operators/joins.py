"""Lookup, spatial and set joins.

Spatial joins never compare all pairs: both sides are put into buckets of the search
width, one side is copied to its neighbouring buckets, and an equi-join on the bucket is
followed by the exact test. Spark picks broadcast or sort-merge and splits skewed buckets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickgrid.functions.expr import distance
from tickgrid.sources.shared import written


def resolve_rules(units: DataFrame, key: str, *dims: DataFrame) -> DataFrame:
    """Look ``key`` up in dimension tables ``(key, class, cost)`` in order; the first that holds it wins, none gives null."""
    ranked = [d.select(key, "class", "cost", F.lit(i).alias("rank")) for i, d in enumerate(dims)]
    rules = ranked[0]
    for d in ranked[1:]:
        rules = rules.unionByName(d)
    best = rules.groupBy(key).agg(F.min_by(F.struct("class", "cost", "rank"), F.struct("rank", "class")).alias("rule"))
    return units.join(best, key, "left").select(*units.columns, "rule.class", "rule.cost", F.col("rule.rank").alias("source"))


def weapon_any(units: DataFrame, kinds: DataFrame, weapons: DataFrame, projectiles: DataFrame, flag: str) -> DataFrame:
    """Units one of whose two weapons has a projectile with ``flag``."""
    able = weapons.join(projectiles.filter(F.col(flag)), "projectile_id", "left_semi").select("weapon_id")
    slots = kinds.select("kind_id", F.explode(F.array("primary_w", "secondary_w")).alias("weapon_id"))
    return units.join(slots.join(able, "weapon_id", "left_semi").select("kind_id"), "kind_id", "left_semi").select(*units.columns)


#: Quarterings of a full bucket at most; what is fuller still is dealt out by row.
DEEPEST = 16


def _tiled(df: DataFrame, width: float, most: int) -> DataFrame:
    """``df`` with ``__tile``, of which none holds more than about ``most`` rows, and its bucket ``__gx, __gy`` of side ``width``.

    A bucket is quartered as often as its count asks for; a quarter that is still too full, as
    points crowd in it or share one place, is dealt into parts. The rows are written, as
    parts go by row number.
    """
    rows = df.filter(_placed(df)).withColumns({f"__g{c}": F.floor(F.col(c) / width) for c in "xy"})
    bucket = ["__gx", "__gy"]
    full = lambda keys: rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > most)
    depth = F.least(F.ceil(F.log(F.col("__n") / most) / F.log(F.lit(4.0))), F.lit(DEEPEST)).cast("int")
    rows = rows.join(full(bucket).select(*bucket, depth.alias("__depth")), bucket, "left").withColumn("__side", F.pow(F.lit(2.0), F.coalesce("__depth", F.lit(0))))
    quarter = lambda c: F.least(F.floor((F.col(c) / width - F.col(f"__g{c}")) * F.col("__side")), F.col("__side") - 1).cast("long")
    rows = rows.withColumns({f"__q{c}": quarter(c) for c in "xy"}).drop("__depth", "__side")
    quarters = [*bucket, "__qx", "__qy"]
    parts = full(quarters).select(*quarters, F.ceil(F.col("__n") / most).alias("__parts"))
    part = F.monotonically_increasing_id() % F.coalesce("__parts", F.lit(1))
    rows = rows.join(parts, quarters, "left").withColumn("__tile", F.struct(*quarters, part.alias("__part")))
    return written(rows.drop("__qx", "__qy", "__parts"), "tiled")


def _tiles(rows: DataFrame, name: str) -> DataFrame:
    """The tiles of ``_tiled`` rows, as ``name``, with their bounds and numbers of rows."""
    bounds = [f(F.col(c).cast("double")).alias(f"{name}_{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]
    return rows.groupBy(F.col("__tile").alias(name), "__gx", "__gy").agg(*bounds, F.count("*").alias(f"{name}_n"))


def _tile_pairs(a: DataFrame, b: DataFrame, r: float) -> DataFrame:
    """``__a, __b``: tiles within ``r`` of each other, of rows tiled with that width."""
    near = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    left = _tiles(a, "__a").withColumn("__ox", near).withColumn("__oy", near).withColumns({"__gx": F.col("__gx") + F.col("__ox"), "__gy": F.col("__gy") + F.col("__oy")})
    gap = lambda c: F.greatest(F.col(f"__a_{c}0") - F.col(f"__b_{c}1"), F.col(f"__b_{c}0") - F.col(f"__a_{c}1"), F.lit(0.0))
    return left.join(_tiles(b, "__b"), ["__gx", "__gy"]).filter(F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")) <= r).select("__a", "__b")


def radius_join_tiled(a: DataFrame, b: DataFrame, r: float, on: tuple[str, ...] = (), most: int = 20_000) -> DataFrame:
    """``radius_join`` for points that crowd in a few buckets: the same rows, by joins on pairs of tiles of about ``most`` rows each.

    Which tiles lie within ``r`` is found from their counts and bounds alone; both sides follow
    their pairs, so no join key has more than ``most`` rows of a side, and tiles too far apart are
    never compared.
    """
    width = float(max(r, 1))
    a, b = _tiled(a, width, most), _tiled(b, width, most)
    pairs = written(_tile_pairs(a, b, r), "pairs")
    side = lambda rows, name: rows.drop("__gx", "__gy").withColumnRenamed("__tile", name).join(pairs, name)
    left, right = side(a, "__a"), side(b, "__b").withColumnsRenamed({"x": "bx", "y": "by"})
    d = distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    return left.join(right, ["__a", "__b", *on]).withColumn("distance", d).filter(F.col("distance") <= r).drop("__a", "__b")


def radius_join(a: DataFrame, b: DataFrame, r: float, on: tuple[str, ...] = ()) -> DataFrame:
    """All pairs at Euclidean distance of at most ``r``, with ``distance``.

    Both sides have ``x, y``; other names must not clash. The columns of ``b`` are kept
    with its place as ``bx, by``. ``on`` names columns that must be equal too. Where many
    points share a bucket of side ``r``, see ``radius_join_tiled``.
    """
    width = float(max(r, 1))
    cell = lambda c: F.floor(F.col(c) / width)
    near = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    left = a.withColumn("__ox", near).withColumn("__oy", near).withColumns({"__gx": cell("x") + F.col("__ox"), "__gy": cell("y") + F.col("__oy")}).drop("__ox", "__oy")
    right = b.withColumns({"__gx": cell("x"), "__gy": cell("y")}).withColumnsRenamed({"x": "bx", "y": "by"})
    d = distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    return left.join(right, ["__gx", "__gy", *on]).withColumn("distance", d).filter(F.col("distance") <= r).drop("__gx", "__gy")


def box_join(points: DataFrame, boxes: DataFrame, width: int) -> DataFrame:
    """Pairs with the point inside the box ``x0 <= x < x1, y0 <= y < y1``; ``width`` is a usual box side."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    left = points.withColumns({"__gx": F.floor(F.col("x") / width), "__gy": F.floor(F.col("y") / width)})
    right = boxes.filter("x1 > x0 and y1 > y0").withColumn("__gx", span("x0", "x1")).withColumn("__gy", span("y0", "y1"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return left.join(right, ["__gx", "__gy"]).filter(inside).drop("__gx", "__gy")


def box_join_tiled(points: DataFrame, boxes: DataFrame, width: int, most: int = 20_000) -> DataFrame:
    """``box_join`` for points or boxes that crowd in a few buckets: the same rows, by joins on tiles of about ``most`` points and parts of as many boxes."""
    rows = _tiled(points, float(width), most)
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    right = boxes.filter("x1 > x0 and y1 > y0").withColumn("__gx", span("x0", "x1")).withColumn("__gy", span("y0", "y1"))
    touches = (F.col("__t_x1") >= F.col("x0")) & (F.col("__t_x0") < F.col("x1")) & (F.col("__t_y1") >= F.col("y0")) & (F.col("__t_y0") < F.col("y1"))
    met = written(right.join(_tiles(rows, "__t"), ["__gx", "__gy"]).filter(touches).select("__t", *boxes.columns), "boxes")
    parts = met.groupBy("__t").agg(F.ceil(F.count("*") / most).alias("__parts"))
    met = written(met.join(parts, "__t").withColumn("__p", F.monotonically_increasing_id() % F.col("__parts")).drop("__parts"), "boxes")
    left = rows.drop("__gx", "__gy").withColumnRenamed("__tile", "__t").join(parts, "__t").withColumn("__p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__parts")
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return left.join(met, ["__t", "__p"]).filter(inside).drop("__t", "__p")


#: Places in a finest cell of the pyramid at most, unless halving the cells no longer parts them.
LEAF = 16

#: Levels of the pyramid that one plan goes down before it is written.
LEVELS_A_PLAN = 6


def _placed(df: DataFrame) -> Column:
    """Whether a row has a finite place."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return finite("x") & finite("y")


def pyramid(places: DataFrame, id_column: str, side: float, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, int]:
    """``_pyramid`` without its measures."""
    return _pyramid(places, side, leaf)[:3]


def _cell(c: str, low: float, side: float) -> Column:
    return F.floor((F.col(c).cast("double") - low) / side).cast("long")


def _pyramid(places: DataFrame, side: float, leaf: int) -> tuple[DataFrame, DataFrame, int, dict[str, float], float]:
    """Occupied cells at all levels, the places with their finest cell, the number of levels, and corner and side of the finest cells.

    ``places(x, y, id)`` are distinct and finite. Level 0 holds the finest cells: their side is
    ``side``, halved until none has more than ``leaf`` places. A cell of the next level is
    twice as wide; the last level is a single cell. A row ``level, gx, gy, n, x0, x1, y0, y1`` counts a cell's
    places and bounds them tightly, so empty space costs nothing.
    """
    low_x, high_x, low_y, high_y = places.agg(*[f(F.col(c).cast("double")) for c in ("x", "y") for f in (F.min, F.max)]).first()
    extent = max(high_x - low_x, high_y - low_y)
    smallest = max(extent, side) * 2.0**-48  # a double's places part no further
    while True:
        cells = places.withColumns({"gx": _cell("x", low_x, side), "gy": _cell("y", low_y, side)})
        fullest = cells.groupBy("gx", "gy").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if fullest <= leaf or side / 2 < smallest:
            break
        side /= 2
    top = int(extent / side).bit_length()
    cells = written(cells, "places")
    box = [F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    finest = cells.groupBy("gx", "gy").agg(*box)
    level = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    up = [F.call_function("shiftright", F.col(c), F.col("level")).alias(c) for c in ("gx", "gy")]
    merged = level.select("level", *up, "n", "x0", "x1", "y0", "y1").groupBy("level", "gx", "gy")
    levels = merged.agg(F.sum("n").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return written(levels, "pyramid"), cells, top, {"x": low_x, "y": low_y}, side


#: Lengths of a step by its two parts; each part may only raise it.
METRICS = {"euclidean": lambda a, b: F.sqrt(a * a + b * b), "manhattan": lambda a, b: a + b}


def _descend(asked: DataFrame, levels: DataFrame, top: int, metric: str = "euclidean") -> DataFrame:
    """``x, y, gx, gy``: for each asked place the finest cells in which its closest place may be.

    With columns BOX an asked row ``x, y`` stands for all places inside those bounds, and gets the cells of them all.
    """
    box = [c for c in BOX if c in asked.columns]
    low, high = ({c: F.col(f"__{c}{i}" if box else c).cast("double") for c in "xy"} for i in (0, 1))
    gap = lambda c: F.greatest(F.col(f"{c}0") - high[c], low[c] - F.col(f"{c}1"), F.lit(0.0))
    far = lambda c: F.greatest(F.abs(high[c] - F.col(f"{c}0")), F.abs(low[c] - F.col(f"{c}1")))
    length = METRICS[metric]
    at_least, at_most = length(gap("x"), gap("y")), length(far("x"), far("y"))
    own = W.partitionBy("x", "y")
    front = asked.withColumns({"gx": F.lit(0).cast("long"), "gy": F.lit(0).cast("long")})
    for k in range(top - 1, -1, -1):
        quarter = [F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c) for c in ("gx", "gy")]
        front = front.select("x", "y", *box, quarter[0], "gy").select("x", "y", *box, "gx", quarter[1])
        cells = levels.filter(F.col("level") == k).select("gx", "gy", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")])
        front = front.join(cells, ["gx", "gy"]).select("x", "y", *box, "gx", "gy", at_least.alias("low"), F.min(at_most).over(own).alias("best"))
        front = front.filter("low <= best").select("x", "y", *box, "gx", "gy")
        if k and (top - k) % LEVELS_A_PLAN == 0:
            front = written(front, "front")
    return front.select("x", "y", "gx", "gy")


#: Bounds of the places that an asked row of ``_descend`` stands for.
BOX = ("__x0", "__x1", "__y0", "__y1")
#: Asked rows of a cell that are searched for together, rows of a group in one task, and distances in memory at once; all bound memory only.
ASKED, GROUP_ROWS, DISTANCES = 4_096, 100_000, 1 << 20


def _closest(metric: str, a_id: str, b_id: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The closest of the right rows of the same ``__key`` for each left row; ties go to the smallest id."""
    length = {"euclidean": lambda a, b: np.sqrt(a * a + b * b), "manhattan": lambda a, b: a + b}[metric]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("__key")
        right = right.take(pc.sort_indices(right, [("__key", "ascending"), (b_id, "ascending")], null_placement="at_start"))
        lx, ly, rx, ry = (t.column(c).to_numpy() for t in (left, right) for c in ("x", "y"))
        keys = left.column("__key").to_numpy()
        kinds, first = np.unique(keys, return_index=True)
        starts, ends = (np.searchsorted(right.column("__key").to_numpy(), kinds, side) for side in ("left", "right"))
        at, best = np.zeros(len(keys), np.int64), np.zeros(len(keys))
        for begin, end, r0, r1 in zip(first, np.append(first[1:], len(keys)), starts, ends):
            step = max(1, DISTANCES // (r1 - r0))
            for i in range(begin, end, step):
                j = min(i + step, end)
                d = length(np.abs(lx[i:j, None] - rx[r0:r1]), np.abs(ly[i:j, None] - ry[r0:r1]))
                low = d.argmin(axis=1)
                at[i:j], best[i:j] = low + r0, d[np.arange(j - i), low]
        return pa.table({a_id: left.column(a_id), b_id: right.column(b_id).take(pa.array(at)), "distance": best})

    return run


def nearest(a: DataFrame, b: DataFrame, a_id: str, b_id: str, r: float, leaf: int = LEAF, metric: str = "euclidean") -> DataFrame:
    """The closest ``b`` of each ``a`` by one of METRICS, as ``a_id, b_id, distance``; ties go to the smallest id.

    The places of ``b`` are counted into a pyramid of occupied cells. The places of ``a`` are put into
    cells as wide as its finest ones, and each of these goes down the pyramid from the top, all a level at a time: a cell is
    left where its closest corner is further than the furthest corner of another. So a cell of ``a`` meets a few cells a
    level and some ``leaf`` places of each at the end, however dense or far ``b`` is, and levels grow with the
    logarithm of the extent. ``r`` is the side of a cell to begin with, say a usual distance.

    Cells of ``a`` and the places that they meet are dealt into groups of about GROUP_ROWS rows, a group in one task; a crowded
    cell is several parts. Rows whose place is null, NaN or infinite have no partner and are none; an empty ``b`` gives no rows.
    """
    place = [F.col(c).cast("double").alias(c) for c in "xy"]
    a, b = a.filter(_placed(a)).select(a_id, *place), b.filter(_placed(b)).select(b_id, *place)
    places = written(b.groupBy("x", "y").agg(F.min(b_id).alias(b_id)), "places")
    if places.isEmpty():
        return a.select(a_id).join(b.select(b_id), F.lit(False)).withColumn("distance", F.lit(0.0))
    levels, cells, top, low, side = _pyramid(places, float(r), leaf)
    asked = a.withColumns({f"__q{c}": _cell(c, low[c], side) for c in "xy"})
    bounds = [f(c).alias(f"__{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]
    boxes = written(asked.groupBy("__qx", "__qy").agg(*bounds, F.count("*").alias("__n")), "boxes")
    front = written(_descend(boxes.select(F.col("__qx").alias("x"), F.col("__qy").alias("y"), *BOX), levels, top, metric).withColumnsRenamed({"x": "__qx", "y": "__qy"}), "front")
    parts = boxes.select("__qx", "__qy", F.ceil(F.col("__n") / ASKED).alias("__parts"))
    met = front.hint("merge").join(cells, ["gx", "gy"]).join(parts, ["__qx", "__qy"]).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
    key = F.xxhash64("__qx", "__qy", "__part")
    met = written(met.select("__qx", "__qy", "__part", b_id, "x", "y"), "met")
    groups = 1 + (boxes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0] + met.count()) // GROUP_ROWS
    own = asked.join(parts.filter("__parts > 1"), ["__qx", "__qy"], "left").withColumn("__part", F.pmod(F.xxhash64(a_id, "x", "y"), F.coalesce("__parts", F.lit(1).cast("long"))))
    dealt = lambda rows, of: rows.select(F.pmod(key, F.lit(groups)).alias("__group"), key.alias("__key"), of, "x", "y").groupBy("__group")
    kinds = [f"`{c}` {t.schema[c].dataType.simpleString()}" for t, c in ((a, a_id), (b, b_id))]
    return dealt(own, a_id).cogroup(dealt(met, b_id)).applyInArrow(_closest(metric, a_id, b_id), f"{', '.join(kinds)}, distance double")


def growing_radius_alert(points: DataFrame, enemies: DataFrame, r0: float, rate: float, max_tick: int) -> DataFrame:
    """``tick, point_id``: from tick 0 to ``max_tick`` the points with an enemy within ``r0 + rate * tick``.

    A point's first tick follows from its closest enemy, and all later ones are alike.
    """
    near = radius_join(points, enemies, r0 + rate * max_tick).groupBy("point_id").agg(F.min("distance").alias("distance"))
    # One tick early, then tested exactly, so that rounding of the division does not matter. A radius that does not grow is met at once.
    first = F.greatest(F.ceil((F.col("distance") - r0) / rate) - 1, F.lit(0)).cast("long") if rate else F.lit(0).cast("long")
    ticks = near.select("point_id", "distance", F.explode(F.sequence(first, F.lit(max_tick).cast("long"))).alias("tick"))
    return ticks.filter(F.col("distance") <= r0 + rate * F.col("tick")).select("tick", "point_id")


def filter_far_candidates(cands: DataFrame, own: DataFrame, amounts: DataFrame, min_amount: float, min_dist: float, size: int, keep_zero: bool = True) -> DataFrame:
    """Candidates at least ``min_dist`` from any own unit, in sectors with enough of the resource; none at all passes with ``keep_zero``."""
    close = radius_join(cands.select("cell_id", "x", "y"), own.select("x", "y"), min_dist).filter(F.col("distance") < min_dist).select("cell_id")
    amount = F.coalesce("amount", F.lit(0.0))
    enough = (amount >= min_amount) | ((amount == 0) & F.lit(keep_zero))
    sect = cands.withColumns({"sx": F.floor(F.col("x") / size).cast("int"), "sy": F.floor(F.col("y") / size).cast("int")}).drop("amount")
    return sect.join(amounts, ["sx", "sy"], "left").filter(enough).join(close, "cell_id", "left_anti").select("cell_id", "x", "y")


def best_target(attackers: DataFrame, targets: DataFrame, scan: float) -> DataFrame:
    """Per attacker the closest target that its weapon can hit, among those within ``scan`` of the squad's leader.

    ``attackers``: squad, unit_id, x, y, reach, anti_air, anti_ground; the leader has the
    shortest reach. ``targets``: target_id, x, y, airborne. Attackers that can hit none
    give no row.
    """
    lead = attackers.groupBy("squad").agg(F.min_by(F.struct("x", "y"), F.struct("reach", "unit_id")).alias("p")).select("squad", "p.x", "p.y")
    seen = radius_join(lead, targets, scan).select("squad", "target_id", F.col("bx").alias("tx"), F.col("by").alias("ty"), "airborne")
    pairs = attackers.join(seen, "squad").filter(F.when(F.col("airborne"), F.col("anti_air")).otherwise(F.col("anti_ground")))
    d = distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))
    return pairs.groupBy("squad", "unit_id").agg(F.min(F.struct(d.alias("distance"), "target_id")).alias("m")).select("squad", "unit_id", "m.target_id", "m.distance")


#: Steps to the eight neighbours: x, y, weight, compass point with y growing southwards.
NEIGHBOURS = [(-1, -1, 0.707, "NW"), (0, -1, 1.0, "N"), (1, -1, 0.707, "NE"), (-1, 0, 1.0, "W"), (1, 0, 1.0, "E"), (-1, 1, 0.707, "SW"), (0, 1, 1.0, "S"), (1, 1, 0.707, "SE")]


def neighbours8(cells: DataFrame, key: str = "cell_id") -> DataFrame:
    """Each cell with its existing neighbours: ``key, neighbour, weight, direction``.

    Both sides have a row a cell, so the join is never broadcast: few bytes in a compressed file may be more rows than a driver holds.
    """
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("weight"), F.lit(d).alias("direction")) for dx, dy, w, d in NEIGHBOURS])
    left = cells.select(key, "x", "y", F.explode(steps).alias("s")).select(key, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "s.weight", "s.direction")
    return left.join(cells.select(F.col(key).alias("neighbour"), "x", "y").hint("merge"), ["x", "y"]).select(key, "neighbour", "weight", "direction")


def standing(a: DataFrame, labels: DataFrame, a_id: str) -> DataFrame:
    """``a_id, region``: the region that each ``a`` stands in."""
    return a.join(labels.select("x", "y", "region").hint("merge"), ["x", "y"]).select(a_id, "region")


def touching(b: DataFrame, labels: DataFrame, b_id: str) -> DataFrame:
    """``b_id, region``: the regions of the 3x3 ring around each ``b``, nine at most; ``b`` may stand on a blocked cell.

    Labels are spread along rows first and down columns then; neighbours mostly have one region, so that
    is a few rows a cell, where the ring would be nine. A label is never broadcast, as there is one for each cell.
    """
    near = lambda c: F.explode(F.array(*[F.col(c) + F.lit(i) for i in (-1, 0, 1)])).alias(c)
    along = labels.select(near("x"), "y", "region").distinct()
    around = along.select("x", near("y"), "region").distinct()
    return b.select(b_id, "x", "y").join(around.hint("merge"), ["x", "y"]).select(b_id, "region").distinct()


def reachable(a: DataFrame, b: DataFrame, labels: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Pairs ``a_id, b_id`` with a cell of the 3x3 ring around ``b`` in the region that ``a`` stands in.

    ``labels`` gives the region of each passable cell. Pairs are as many as a region's a times
    its b; where few would be read, ``standing`` and ``touching`` say the same in a row or nine each.
    A region that no ``a`` stands in is left out before its ring is made. Pairs are made distinct only for
    an ``a`` of several regions, as those of any other are distinct already.
    """
    stands = written(standing(a, labels, a_id).distinct(), "standing")
    touches = touching(b, labels.join(stands.select("region").distinct(), "region", "left_semi"), b_id)
    several = stands.groupBy(a_id).count().filter("count > 1").select(a_id)
    pairs = lambda some: touches.join(some, "region").select(a_id, b_id)
    once = pairs(stands.join(several, a_id, "left_anti"))
    if several.isEmpty():
        return once
    return once.unionByName(pairs(stands.join(several, a_id, "left_semi")).distinct())


def feasible_sets(sets: DataFrame, available: DataFrame) -> DataFrame:
    """Sets ``(set_id, members map)`` all of whose members are available."""
    need = sets.select("set_id", F.explode_outer(F.map_keys("members")).alias("item"))
    have = available.select("item").distinct().withColumn("have", F.lit(1))
    counted = need.join(have, "item", "left").groupBy("set_id").agg(F.count("item").alias("need"), F.count("have").alias("have"))
    return counted.filter("need = have").select("set_id")


def missing_members(target: DataFrame, actual: DataFrame) -> DataFrame:
    """``item, target, missing`` where fewer than a positive target are there."""
    n = actual.groupBy("item").agg(F.count("*").alias("n"))
    short = F.col("target") - F.coalesce("n", F.lit(0))
    return target.filter("target > 0").join(n, "item", "left").withColumn("missing", short).filter("missing > 0").select("item", "target", "missing")


def audit_assignments(assign: DataFrame, units: DataFrame) -> DataFrame:
    """Assigned ids that no longer exist, and ids in more than one group: ``unit_id, problem``."""
    dead = assign.join(units.select("unit_id"), "unit_id", "left_anti").select("unit_id").distinct().withColumn("problem", F.lit("dead"))
    twice = assign.select("unit_id", "group_id").distinct().groupBy("unit_id").agg(F.count("*").alias("n")).filter("n > 1")
    return dead.unionByName(twice.select("unit_id", F.lit("shared").alias("problem")))


def unseen_starts(starts: DataFrame, cells: DataFrame, own: Column) -> DataFrame:
    """Start places, other than own ones, whose cell exists and is not visible."""
    hidden = cells.filter(~F.col("visible")).select("x", "y")
    return starts.filter(~own).join(hidden, ["x", "y"]).select("player", "x", "y")


def expired_requests(requests: DataFrame, claims: DataFrame, ttl: int) -> DataFrame:
    """Requests that no claim with their item follows within ``ttl`` ticks.

    Claims are met bucket by bucket of ``ttl`` ticks, so a common item is spread over time.
    """
    r = requests.withColumn("__b", F.explode(F.array(F.floor(F.col("tick") / ttl), F.floor((F.col("tick") + ttl) / ttl))))
    c = claims.select(F.col("item").alias("c_item"), F.col("tick").alias("c_tick"), F.floor(F.col("tick") / ttl).alias("c_b"))
    met = r.join(c, (F.col("item") == F.col("c_item")) & (F.col("__b") == F.col("c_b")) & F.col("c_tick").between(F.col("tick"), F.col("tick") + ttl), "left_semi")
    return requests.join(met.select("request_id").distinct(), "request_id", "left_anti")
