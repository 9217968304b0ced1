"""Ranking, top-k, one-pass allocation and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickgrid.functions.expr import distance, half_up, sector
from tickgrid.operators.joins import box_join, radius_join
from tickgrid.operators.rules import RuleBook


def _first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def merge_requests(*shapes: DataFrame) -> DataFrame:
    """Union requests of several shapes; per item the highest priority wins, the smallest request_id on ties."""
    out = shapes[0]
    for s in shapes[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    rest = F.struct(*[c for c in out.columns if c != "item"])
    best = out.groupBy("item").agg(F.max_by(rest, F.struct("priority", -F.col("request_id"))).alias("r"))
    return best.select("item", "r.*")


def assign_free(units: DataFrame, requests: DataFrame, grabs: DataFrame) -> DataFrame:
    """Give each requested item one unit, then leftovers to the first grab in reach.

    ``units``: unit_id, item, x, y, donor, donor_priority (null donor: free), combatant;
    ``requests``: item, requester, priority; ``grabs``: grab_id, requester, priority, x, y,
    radius. A donor may not outrank the request nor be the requester; the unit of the lowest
    donor priority is taken. Of grabs in reach the one of the highest priority wins.
    """
    fit = units.join(requests.select("item", "requester", F.col("priority").alias("wanted")), "item")
    rank = F.coalesce("donor_priority", F.lit(0.0))
    fit = fit.filter(F.col("donor").isNull() | ((F.col("donor") != F.col("requester")) & (rank < F.col("wanted"))))
    won = fit.groupBy("item").agg(F.min(F.struct(rank.alias("rank"), "unit_id", "requester")).alias("w")).select("w.unit_id", "w.requester", F.lit("request").alias("method"))
    left = units.filter(F.col("combatant") & F.col("donor").isNull()).join(won, "unit_id", "left_anti").select("unit_id", "x", "y")
    reach = float(grabs.agg(F.coalesce(F.max("radius"), F.lit(0.0))).first()[0])
    near = radius_join(left, grabs, reach).filter(F.col("distance") <= F.col("radius"))
    grabbed = near.groupBy("unit_id").agg(F.max(F.struct("priority", (-F.col("grab_id")).alias("order"), "requester")).alias("g"))
    return won.unionByName(grabbed.select("unit_id", "g.requester", F.lit("grab").alias("method")))


def queue_decisions(options: DataFrame, requests: DataFrame, queues: DataFrame) -> DataFrame:
    """What each production queue should do.

    ``options``: player, queue, item, cost; ``requests``: player, item, priority; ``queues``:
    player, queue, status, current, credits. The best requested option of a queue is its
    decision; weights and costs are summed over a player's queues, one without a decision
    counting 0.
    """
    asked = options.join(requests, ["player", "item"])
    top = asked.groupBy("player", "queue").agg(F.max_by(F.struct("item", "priority", "cost"), F.struct("priority", "item")).alias("d"))
    now = requests.select("player", F.col("item").alias("current"), F.col("priority").alias("current_priority"))
    q = queues.join(top, ["player", "queue"], "left").join(now, ["player", "current"], "left").select("*", F.col("d.item").alias("decision"), F.col("d.priority").alias("priority"))
    own = W.partitionBy("player")
    weight = F.sum(F.coalesce("priority", F.lit(0.0))).over(own)
    cost = F.sum(F.coalesce(F.col("d.cost"), F.lit(0.0))).over(own)
    q = q.withColumn("weight", weight).withColumn("cost", cost)
    act = (
        F.when((F.col("status") == "idle") & F.col("decision").isNotNull(), "start")
        .when((F.col("status") == "active") & (F.col("decision") != F.col("current")) & (F.col("priority") > 2 * F.coalesce("current_priority", F.lit(0.0))), "switch")
        .when((F.col("status") == "active") & (F.col("decision") == F.col("current")) & (F.col("cost") > F.col("credits")) & (F.col("priority") < 0.25 * F.col("weight")), "pause")
        .when((F.col("status") == "hold") & ((F.col("credits") >= F.col("cost")) | (F.col("priority") >= 0.25 * F.col("weight"))), "resume")
        .otherwise("none")
    )
    return q.select("player", "queue", "decision", "priority", "weight", "cost", act.alias("action"))


def scout_ranking(sectors: DataFrame, cx: int, cy: int, radius: int, base: float, k: int, starts: DataFrame | None = None) -> DataFrame:
    """The ``k`` best sectors ``(sx, sy, ratio)`` to scout in a square around a sector, unseen starts ahead at 900."""
    d = distance(F.col("sx"), F.col("sy"), F.lit(cx), F.lit(cy))
    ratio = F.coalesce("ratio", F.lit(0.0))
    near = sectors.filter((F.abs(F.col("sx") - cx) <= radius) & (F.abs(F.col("sy") - cy) <= radius) & (ratio < 0.8))
    out = near.select("sx", "sy", ((base - d) * (1 - ratio)).alias("score")).filter("score > 0")
    if starts is not None:
        out = out.unionByName(starts.select("sx", "sy", F.lit(900.0).alias("score")))
    return out.orderBy(F.desc("score"), "sx", "sy").limit(k)


def ring_expansion(cells: DataFrame, cx: int, cy: int, r0: int, step: int, ticks: int) -> DataFrame:
    """Cells by the step and tick at which a square growing by ``step`` first holds them; each once."""
    far = F.greatest(F.abs(F.col("x") - cx), F.abs(F.col("y") - cy))
    n = F.greatest(F.lit(0), F.ceil((far - r0) / step)).cast("long")
    return cells.groupBy(n.alias("step")).agg(F.count("*").alias("cells")).withColumn("tick", F.col("step") * step * ticks)


def recent_rows(events: DataFrame, by: str, n: int = 20) -> DataFrame:
    """The last ``n`` rows per key, by tick and event_id."""
    order = W.partitionBy(by).orderBy(F.desc("tick"), F.desc("event_id"))
    return events.withColumn("age", F.row_number().over(order)).filter(F.col("age") <= n)


def closest_free_cell(cells: DataFrame, bases: DataFrame, size: int, gap: int, tx: int, ty: int) -> DataFrame:
    """Per owner the free cell nearest to a target, in boxes ``gap`` wide around own bases but not inside any base."""
    box = lambda pad: bases.select("owner", (F.col("x") - pad).alias("x0"), (F.col("y") - pad).alias("y0"), (F.col("x") + size + pad).alias("x1"), (F.col("y") + size + pad).alias("y1"))
    free = cells.filter(~F.col("blocked")).select("cell_id", "x", "y")
    around = box_join(free, box(gap), size + 2 * gap).select("owner", "cell_id", "x", "y").distinct()
    inner = box_join(free, box(0).drop("owner"), size + 2 * gap).select("cell_id").distinct()
    d = distance(F.col("x"), F.col("y"), F.lit(tx), F.lit(ty))
    return around.join(inner, "cell_id", "left_anti").groupBy("owner").agg(F.min(F.struct(d.alias("distance"), "cell_id")).alias("m")).select("owner", "m.cell_id", "m.distance")


def build_ranking(options: DataFrame, book: RuleBook) -> DataFrame:
    """Per player and queue the option of the highest priority; only positive ones are chosen, and none of which there are as many as the book allows."""
    room = F.col("__most").isNull() | (F.col("owned") < F.col("__most"))
    scored = options.withColumn("__most", book.max_count()).filter(room).withColumn("priority", book.priority()).filter("priority > 0")
    best = scored.groupBy("player", "queue").agg(F.max_by(F.struct("item", "priority"), F.struct("priority", "item")).alias("b"))
    return best.select("player", "queue", "b.*")


def pick_target(units: DataFrame, viewers: DataFrame, enemies: DataFrame, starts: DataFrame, focus: Column, building: Column) -> DataFrame:
    """Per viewer the enemy unit of the largest weight, else an unseen enemy start, else none.

    ``enemies`` pairs viewer with owner. Each owner's best unit is found first, so pairs of
    viewers and units are never made.
    """
    weight = F.when(focus, 100000.0).when(building, F.col("max_hp") * 10).otherwise(F.col("max_hp"))
    top = units.groupBy("owner").agg(F.max(F.struct(weight.alias("weight"), (-F.col("unit_id")).alias("neg"), "x", "y")).alias("t"))
    unit = enemies.join(top, "owner").groupBy("viewer").agg(F.max("t").alias("t"))
    place = enemies.join(starts.select(F.col("player").alias("owner"), F.col("x").alias("sx"), F.col("y").alias("sy")), "owner").groupBy("viewer").agg(F.min(F.struct("owner", "sx", "sy")).alias("s"))
    out = viewers.join(unit, "viewer", "left").join(place, "viewer", "left")
    kind = F.when(F.col("t").isNotNull(), "unit").when(F.col("s").isNotNull(), "start").otherwise("none")
    return out.select("viewer", kind.alias("kind"), (-F.col("t.neg")).alias("unit_id"), F.coalesce("t.x", "s.sx").alias("x"), F.coalesce("t.y", "s.sy").alias("y"))


def split_quota(sets: DataFrame, total: int, priority: float, owned: DataFrame) -> DataFrame:
    """Whole targets per member in proportion to weights (halves up), what is missing of each, and its share of a priority.

    The share goes by the number missing among all missing of the set; it is null where the
    set misses none. ``owned(set_id, item, owned)`` has a row per member at most.
    """
    rows = sets.select("set_id", F.explode("members").alias("item", "w"))
    own = W.partitionBy("set_id")
    target = half_up(total * F.col("w") / F.sum("w").over(own)).cast("long")
    counted = rows.withColumn("target", target).join(owned, ["set_id", "item"], "left")
    missing = counted.withColumn("missing", F.greatest(F.col("target") - F.coalesce("owned", F.lit(0)), F.lit(0)).cast("long"))
    share = F.try_divide(F.lit(priority) * F.col("missing"), F.sum("missing").over(own))
    return missing.withColumn("share", share).select("set_id", "item", "target", "missing", "share")


def seeded_pick(df: DataFrame, by: str, key: str, seed: str) -> DataFrame:
    """One repeatable row per group: the smallest MD5 of key and seed."""
    return _first(df, [by], [F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), F.col(key)])
