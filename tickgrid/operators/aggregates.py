"""Aggregations by sector, owner and group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickgrid.functions.expr import distance, firepower, half_up, sector
from tickgrid.operators.joins import box_join
from tickgrid.operators.predicates import with_relation


def _sectors(size: int) -> list[Column]:
    return [sector(F.col("x"), size).alias("sx"), sector(F.col("y"), size).alias("sy")]


def sector_threat(units: DataFrame, players: DataFrame, viewer: int, size: int) -> DataFrame:
    """Enemy health minus own health per sector; others count nothing, missing health counts 1."""
    health = F.coalesce("max_hp", F.lit(1.0))
    signed = F.when(F.col("relation") == "enemy", health).when(F.col("relation") == "self", -health).otherwise(0.0)
    return with_relation(units, players, viewer).groupBy(*_sectors(size)).agg(F.sum(signed).alias("threat"))


def armed(units: DataFrame, kinds: DataFrame, weapons: DataFrame, projectiles: DataFrame) -> DataFrame:
    """Units with ``power``, from the two weapons of their kind, and whether either can hit the ground or the air."""
    hits = weapons.join(projectiles, "projectile_id", "left")
    w = lambda p: hits.select(F.col("weapon_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("damage", "range", "rof", "anti_ground", "anti_air")])
    rules = kinds.join(w("p"), F.col("primary_w") == F.col("p_id"), "left").join(w("s"), F.col("secondary_w") == F.col("s_id"), "left")
    power = firepower(F.col("hp"), F.col("max_hp"), [tuple(F.col(f"{p}_{c}") for c in ("damage", "range", "rof")) for p in "ps"])
    either = lambda c: F.coalesce(f"p_{c}", F.lit(False)) | F.coalesce(f"s_{c}", F.lit(False))
    out = units.join(rules.drop("name"), "kind_id", "left").withColumn("power", power)
    return out.withColumn("anti_ground", either("anti_ground")).withColumn("anti_air", either("anti_air"))


def power_totals(
    units: DataFrame, kinds: DataFrame, weapons: DataFrame, projectiles: DataFrame, players: DataFrame, cells: DataFrame, viewer: int,
    ground: Column, flying: Column, building: Column, combatant: Column, size: int = 8,
) -> DataFrame:
    """Nine totals in one row: how certain the view is (visible share), and the power seen and owned.

    Of enemies the units on the ground, those that fly, those other than buildings that hit
    the air, and buildings that hit the ground; of the viewer's own the buildings that hit the
    ground, combatants that hit the ground, combatants and buildings that hit the air, and
    flying combatants. The four classes are given as conditions over a unit with its kind.
    """
    u = armed(with_relation(units, players, viewer), kinds, weapons, projectiles)
    enemy, own = F.col("relation") == "enemy", F.col("relation") == "self"
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("power"))), F.lit(0.0))
    totals = u.agg(
        total(enemy & ground).alias("enemy_ground"), total(enemy & flying).alias("enemy_air"), total(enemy & ~building & F.col("anti_air")).alias("enemy_anti_air"), total(enemy & building & F.col("anti_ground")).alias("enemy_defence"),
        total(own & building & F.col("anti_ground")).alias("own_defence"), total(own & combatant & F.col("anti_ground")).alias("own_anti_ground"), total(own & (combatant | building) & F.col("anti_air")).alias("own_anti_air"), total(own & flying & combatant).alias("own_air"),
    )
    return totals.crossJoin(overall_visibility(cells, size).select(F.col("visibility").alias("certainty")))  # one row each


def visibility(cells: DataFrame, size: int) -> DataFrame:
    """Per sector the valid, visible and clear cells and the visible ratio; null ratio where none is valid."""
    valid = F.count("terrain")
    seen = F.count(F.when(F.col("terrain").isNotNull() & F.col("visible"), 1))
    clear = F.count(F.when(F.col("terrain").isNotNull() & ~F.col("blocked"), 1))
    return cells.groupBy(*_sectors(size)).agg(valid.alias("valid"), seen.alias("seen"), clear.alias("clear"), F.try_divide(seen, valid).alias("ratio"))


def overall_visibility(cells: DataFrame, size: int) -> DataFrame:
    """The mean of the sectors' ratios, each sector counting alike."""
    return visibility(cells, size).agg(F.avg("ratio").alias("visibility"), F.count("ratio").alias("sectors"))


def amount_per_sector(cells: DataFrame, size: int) -> DataFrame:
    return cells.groupBy(*_sectors(size)).agg(F.sum(F.coalesce("amount", F.lit(0.0))).alias("amount"))


def freshness(cells: DataFrame, since: Column) -> DataFrame:
    """The share of cells updated at or after ``since``; never updated counts as old."""
    return cells.agg(F.avg(F.when(F.col("updated") >= since, 1.0).otherwise(0.0)).alias("fresh"), F.count("*").alias("cells"))


def composition(units: DataFrame, by: str, kind: str) -> DataFrame:
    """Units of each kind per group, as a map and as a line of text in order of the kind."""
    counts = units.groupBy(by, kind).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(kind).alias("k"), F.col("n"))))
    out = counts.groupBy(by).agg(pairs.alias("pairs"))
    line = F.array_join(F.transform("pairs", lambda p: F.concat_ws(":", p["k"], p["n"])), ", ")
    return out.select(by, F.map_from_entries("pairs").alias("counts"), line.alias("line"))


def batch_orders(orders: DataFrame, most: int = 10_000) -> DataFrame:
    """The units' ids per order type and target, order type and point, or order type alone, in parts.

    A group is cut by the remainder of the id into as few parts as have about ``most`` ids
    each, numbered from 0, so no array grows with the data.
    """
    at = lambda c: F.when(F.col("target_id").isNull(), F.col(c)).alias(c)
    keys = ["order_type", "target_id", "px", "py"]
    rows = orders.select("unit_id", "order_type", "target_id", at("px"), at("py"))
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("parts")).withColumnsRenamed({k: f"g_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in keys])
    dealt = rows.join(parts, same).withColumn("part", F.pmod("unit_id", "parts"))
    return dealt.groupBy(*keys, "part").agg(F.array_sort(F.collect_list("unit_id")).alias("unit_ids"))


def arg_extreme(df: DataFrame, by: list[str], value: str, id_column: str, how: str = "max") -> DataFrame:
    """The whole row with the largest or smallest value per group; null values are skipped, ties go to the smallest id."""
    rest = F.struct(*[c for c in df.columns if c not in by])
    rank = F.struct(F.col(value) if how == "max" else -F.col(value), -F.col(id_column))
    out = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(rest, rank).alias("row"))
    return out.select(*by, "row.*").select(*df.columns)


def unique_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def centroid_spread(units: DataFrame, by: str) -> DataFrame:
    """The rounded mean place of each group and the largest distance from it."""
    centre = units.groupBy(by).agg(half_up(F.avg("x")).cast("int").alias("cx"), half_up(F.avg("y")).cast("int").alias("cy"))
    far = distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
    return units.join(centre, by).groupBy(by, "cx", "cy").agg(F.max(far).alias("spread"), F.count("*").alias("n"))


def row_bounds(cells: DataFrame, size: int) -> DataFrame:
    """Per row of sectors its first and one past its last sector, from the bounds of its rows of cells."""
    rows = cells.groupBy("y").agg(F.min("x").alias("lo"), (F.max("x") + 1).alias("hi"))
    out = rows.groupBy(sector(F.col("y"), size).alias("sy")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.select("sy", F.floor(F.col("lo") / size).cast("int").alias("first"), F.ceil(F.col("hi") / size).cast("int").alias("end"))


def eliminated(players: DataFrame, units: DataFrame, kinds: DataFrame, roles: dict[str, Column]) -> DataFrame:
    """Players who own no unit of any of the roles, given as predicates on kinds."""
    role = units.join(kinds, "kind_id").groupBy("owner").agg(*[F.count(F.when(c, 1)).alias(n) for n, c in roles.items()])
    held = sum((F.coalesce(n, F.lit(0)) for n in roles), F.lit(0))
    return players.join(role, F.col("player") == F.col("owner"), "left").filter(held == 0).select("player")


def assignment_pivot(assign: DataFrame, group: str, kind: str, method: str, methods: list[str]) -> DataFrame:
    """Counts by group and kind with the methods as columns; they are given, so no extra pass finds them."""
    return assign.groupBy(group, kind).pivot(method, methods).count().na.fill(0, methods)


def capacity_plan(harvesters: DataFrame, refineries: DataFrame, bases: DataFrame, reach: int, needed: int = 2, per_refinery: int = 4, ideal: int = 2) -> DataFrame:
    """Per owner how many refineries to have at most and how urgent another harvester is.

    A base without an own refinery in its box wants an expansion. All three tables have
    ``unit_id, owner, x, y``; every owner of a base gets a row.
    """
    boxes = bases.select(F.col("unit_id").alias("base_id"), F.col("owner").alias("base_owner"), (F.col("x") - reach).alias("x0"), (F.col("y") - reach).alias("y0"), (F.col("x") + reach + 1).alias("x1"), (F.col("y") + reach + 1).alias("y1"))
    served = box_join(refineries, boxes, 2 * reach + 1).filter("owner = base_owner").select("base_id").distinct()
    open_bases = bases.join(served, F.col("unit_id") == F.col("base_id"), "left_anti").groupBy("owner").agg(F.count("*").alias("open"))
    n = lambda df, name: df.groupBy("owner").agg(F.count("*").alias(name))
    out = bases.select("owner").distinct()
    for df in (n(harvesters, "h"), n(refineries, "r"), open_bases):
        out = out.join(df, "owner", "left")
    out = out.na.fill(0)
    cap = F.greatest(F.lit(1), F.least(F.lit(6), 2 * F.col("h") * (F.col("open") + 1)))
    boost = F.when(F.col("h") < needed, 3).when(F.col("h") > F.col("r") * per_refinery, 0).otherwise(1)
    priority = F.col("r") / F.greatest(F.col("h") / ideal, F.lit(1.0)) * boost
    return out.select("owner", cap.cast("long").alias("cap"), priority.alias("priority"))
