"""Projections, filters and labels over units, cells and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickgrid.functions.expr import distance, heat_colour, packed, recency, sector


def with_relation(units: DataFrame, players: DataFrame, viewer: int) -> DataFrame:
    """Add ``relation``: self, ally, neutral, non_combatant or enemy; owners that are no player count as neutral."""
    team = players.filter(F.col("player") == viewer).select(F.col("team").alias("viewer_team"))
    known = players.select(F.col("player").alias("owner"), "team", "is_combatant", "is_neutral").crossJoin(F.broadcast(team))
    label = (
        F.when(F.col("owner") == viewer, "self")
        .when(F.col("team").isNull() | F.col("is_neutral"), "neutral")
        .when(F.col("team") == F.col("viewer_team"), "ally")
        .when(~F.col("is_combatant"), "non_combatant")
        .otherwise("enemy")
    )
    return units.join(known, "owner", "left").withColumn("relation", label).select(*units.columns, "relation")


def classify_relation(units: DataFrame, players: DataFrame, viewer: int) -> DataFrame:
    """Count and summed hp of units by how ``viewer`` sees them."""
    return with_relation(units, players, viewer).groupBy("relation").agg(F.count("*").alias("n"), F.sum("hp").alias("hp"))


def filter_class(units: DataFrame, kinds: DataFrame, classes: list[str], combatant: bool = False) -> DataFrame:
    """Units whose kind is of the given classes; ``combatant`` asks for a primary weapon too."""
    wanted = kinds.filter(F.col("class").isin(classes))
    if combatant:
        wanted = wanted.filter(F.col("primary_w").isNotNull())
    return units.join(wanted.select("kind_id"), "kind_id", "left_semi").select(*units.columns)


def buildable_cells(cells: DataFrame, terrains: list[str], max_amount: float = 0.0) -> DataFrame:
    """Cells of allowed terrain that are not blocked and hold at most ``max_amount`` of a resource."""
    return cells.filter(F.col("terrain").isin(terrains) & ~F.col("blocked") & (F.coalesce("amount", F.lit(0.0)) <= max_amount))


def damaged_units(units: DataFrame, busy: Column | None = None) -> DataFrame:
    """Units below full health; null or zero health and units under repair are left out."""
    out = units.filter((F.col("hp") > 0) & (F.col("hp") < F.col("max_hp")))
    return out if busy is None else out.filter(~busy)


def bin_cells(df: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Add the sector, its packed id and its centre; null for places outside the map."""
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    sx, sy = F.when(inside, sector(F.col("x"), size)), F.when(inside, sector(F.col("y"), size))
    centre = lambda s: F.floor(s * size + size / 2).cast("int")
    return df.withColumns({"sx": sx, "sy": sy, "sector_id": packed(sx, sy), "cx": centre(sx), "cy": centre(sy)})


def heatmap_table(df: DataFrame, value: str, size: int) -> DataFrame:
    """Mean value per sector and its colour on the scale of all sectors."""
    means = df.groupBy(sector(F.col("x"), size).alias("sx"), sector(F.col("y"), size).alias("sy")).agg(F.avg(value).alias("mean"))
    scale = means.agg(F.min("mean").alias("low"), F.max("mean").alias("high"))  # one row
    return means.crossJoin(F.broadcast(scale)).select("sx", "sy", "mean", heat_colour(F.col("mean"), F.col("low"), F.col("high")).alias("colour"))


def log_report(events: DataFrame, now: int) -> DataFrame:
    """Each event's tick as ``H:MM:SS`` text (a tick is a second) and its recency weight at tick ``now``."""
    t = F.col("tick")
    clock = F.format_string("%d:%02d:%02d", F.expr("tick div 3600"), F.expr("tick div 60 % 60"), t % 60)
    return events.withColumn("clock", clock).withColumn("weight", recency(now - t))


def choose_order(pairs: DataFrame) -> DataFrame:
    """The order for each attacker and target, by the first rule that holds.

    ``pairs`` has ``ax, ay, tx, ty, stance, reach``. A unit that can deploy (stance not
    null) deploys when near enough and undeploys (stance ``N``) when too far; then it
    attacks from within 80 % of its reach and moves up otherwise.
    """
    d = distance(F.col("ax"), F.col("ay"), F.col("tx"), F.col("ty"))
    deployed = F.col("stance") == "N"
    order = (
        F.when(F.col("stance").isNotNull() & ~deployed & (d <= F.col("reach")), "deploy")
        .when(deployed & (d > F.col("reach")), "undeploy")
        .when(d < F.col("reach") * 0.8, "attack")
        .otherwise("attack_move")
    )
    return pairs.withColumn("distance", d).withColumn("order", order)
