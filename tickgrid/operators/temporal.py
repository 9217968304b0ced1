"""Operators over each key's history, in batch.

Histories are ordered by time, then id. Where state depends only on the past through a
running minimum, maximum or last value, a window does it without gathering a key's rows.

Such a window puts a key's rows in one task. With ``chunk`` (a length of time) it is done in
two levels instead: each chunk of a key is summed up, the summaries are scanned, one row a
chunk, and rows then go through their chunk beginning with what came before. One key may so
hold any share of the rows; the result is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickgrid.sources.shared import written


def _past(key: str, ts: str, id_column: str):
    return W.partitionBy(key).orderBy(ts, id_column)


def _chunks(df: DataFrame, ts: str, chunk: int) -> DataFrame:
    """``df`` with the number of each row's chunk of time; rows without a time come first, as in a window."""
    return df.withColumn("__chunk", F.coalesce(F.floor(F.col(ts) / chunk).cast("long"), F.lit(-(1 << 62))))


def _carry(rows: DataFrame, key: str, parts: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """Add to each row of ``_chunks`` what the key's earlier chunks come to: ``{name: (summary of a chunk, scan over summaries)}``; null in the first."""
    told = rows.groupBy(key, "__chunk").agg(*[summary.alias(name) for name, (summary, _) in parts.items()])
    past = W.partitionBy(key).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    told = told.select(F.col(key).alias("__key"), F.col("__chunk").alias("__own"), *[scan(F.col(name)).over(past).alias(name) for name, (_, scan) in parts.items()])
    return rows.join(told, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__chunk") == F.col("__own"))).drop("__key", "__own")


def _in_chunk(key: str, ts: str, id_column: str):
    return W.partitionBy(key, "__chunk").orderBy(ts, id_column).rowsBetween(W.unboundedPreceding, 0)


def _last(column: Column) -> Column:
    return F.last(column, ignorenulls=True)


def hysteresis(df: DataFrame, key: str, ts: str, id_column: str, enter: Column, stay: Column, chunk: int | None = None) -> DataFrame:
    """Add ``active``: on from where ``enter`` holds until ``stay`` fails. Exact where enter implies stay."""
    flag = F.when(enter, True).when(~stay, False)
    if chunk is None:
        w = _past(key, ts, id_column).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn("active", F.coalesce(_last(flag).over(w), F.lit(False)))
    rows = _chunks(df.withColumn("__flag", flag), ts, chunk)
    summary = F.max_by("__flag", F.when(F.col("__flag").isNotNull(), F.struct(ts, id_column)))
    rows = _carry(rows, key, {"__before": (summary, _last)})
    active = F.coalesce(_last(F.col("__flag")).over(_in_chunk(key, ts, id_column)), F.col("__before"), F.lit(False))
    return rows.select(*df.columns, active.alias("active"))


def phase_by_spread(df: DataFrame, key: str, ts: str, id_column: str) -> DataFrame:
    """Add ``phase``: a squad of ``n`` attacks once its spread is within ``10 sqrt(n) + 5`` and gathers again beyond ``10 sqrt(n) + 15``."""
    near = F.sqrt("n") * 10
    out = hysteresis(df, key, ts, id_column, F.col("spread") <= near + 5, F.col("spread") <= near + 15)
    return out.withColumn("phase", F.when(F.col("active"), "attack").otherwise("gather")).drop("active")


#: Rows of a key up to which ``cooldown`` folds them as one array.
FOLD = 10_000


def cooldown(df: DataFrame, key: str, ts: str, id_column: str, gap: int, strict: bool = False, fold: int = FOLD) -> DataFrame:
    """Keep a row only if at least ``gap`` after the last row kept (more than ``gap`` with ``strict``).

    Whether a row is kept depends on all before it. Keys of at most ``fold`` rows are folded as
    arrays, cut into runs at gaps that no kept row can reach across. The rows of busier keys are
    never gathered: see ``_lifted``. ``gap`` is positive; rows without a key are left out, and of
    a key with more than ``fold`` rows those without a time too.
    """
    if gap <= 0:
        raise ValueError("the gap must be positive")
    busy = written(df.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > fold).select(key), "busy")
    if busy.isEmpty():
        return _folded(df, key, ts, id_column, gap, strict)
    few, many = df.join(busy, key, "left_anti").select(*df.columns), df.join(busy, key, "left_semi").select(*df.columns)
    return _folded(few, key, ts, id_column, gap, strict).unionByName(_lifted(many, key, ts, id_column, gap, strict))


def _folded(df: DataFrame, key: str, ts: str, id_column: str, gap: int, strict: bool) -> DataFrame:
    """``cooldown`` by a fold over each run of a key: the row after a gap that no kept row can reach across is always kept."""
    w = _past(key, ts, id_column)
    since = F.col(ts) - F.lag(ts).over(w)
    passes = since > gap if strict else since >= gap
    runs = df.withColumn("__run", F.sum(F.when(passes, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(id_column).alias("id"))))
    start = F.struct(F.lit(None).cast(df.schema[ts].dataType).alias("last"), F.array().cast(f"array<{df.schema[id_column].dataType.simpleString()}>").alias("ids"))

    def step(state: Column, row: Column) -> Column:
        d = row["t"] - state["last"]
        keep = state["last"].isNull() | (d > gap if strict else d >= gap)
        return F.struct(F.when(keep, row["t"]).otherwise(state["last"]).alias("last"), F.when(keep, F.concat(state["ids"], F.array(row["id"]))).otherwise(state["ids"]).alias("ids"))

    kept = runs.groupBy(key, "__run").agg(F.aggregate(rows, start, step, lambda s: s["ids"]).alias("ids")).select(key, F.explode("ids").alias(id_column))
    return df.join(kept, [key, id_column], "left_semi").select(*df.columns)


def _lifted(df: DataFrame, key: str, ts: str, id_column: str, gap: int, strict: bool) -> DataFrame:
    """``cooldown`` by binary lifting, without a key's rows in one task or array.

    Each time links to the first one that may be kept after it; what is kept is what links
    lead to from the times that are kept whatever came before. The links are doubled in each round,
    and a round marks twice as far, so rounds grow with the logarithm of the kept rows.

    Time is dealt into slots of ``gap``, of which each holds one kept row at most: a link ends in the
    next slot, or at the first time of the one after. If both are empty, the next time there
    is follows a pause, and is kept anyway. So joins and windows are by key and slot.
    """
    t = F.col(ts)
    whole = df.schema[ts].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    slot = F.call_function("div", t - F.pmod(t, F.lit(gap)), F.lit(gap)).cast("long") if whole else F.floor(t / gap).cast("long")
    # Of rows at one time only the first can be kept.
    times = written(df.filter(t.isNotNull()).groupBy(key, ts).agg(F.min(id_column).alias(id_column)).withColumn("__slot", slot), "times")
    slots = written(times.groupBy(key, "__slot").agg(F.min(ts).alias("__first"), F.max(ts).alias("__last")), "slots")

    ends = times.select(key, "__slot", t.alias("__at"), F.lit(None).cast(df.schema[ts].dataType).alias(ts))
    asks = times.select(key, (F.col("__slot") + 1).alias("__slot"), (t + gap).alias("__at"), ts)
    asked = F.col(ts).isNotNull()
    # Backwards in time, the last end seen is the nearest one; at the same time it counts unless more than the gap is wanted.
    back = W.partitionBy(key, "__slot").orderBy(F.desc("__at"), F.desc(asked) if strict else F.asc(asked)).rowsBetween(W.unboundedPreceding, 0)
    near = ends.unionByName(asks).withColumn("__to", _last(F.when(~asked, F.col("__at"))).over(back)).filter(asked)
    after = slots.select(key, (F.col("__slot") - 1).alias("__slot"), F.col("__first").alias("__next"))
    links = near.join(after, [key, "__slot"], "left").select(key, ts, F.coalesce("__to", "__next").alias("__to")).filter("__to is not null")

    last = slots.select(key, (F.col("__slot") + 1).alias("__slot"), F.col("__last").alias("__before"))
    pause = F.col("__first") - F.col("__before")
    begins = slots.join(last, [key, "__slot"], "left").filter(F.col("__before").isNull() | (pause > gap if strict else pause >= gap))

    links, kept = written(links, "links"), written(begins.select(key, F.col("__first").alias(ts)), "kept")
    while True:
        more = kept.join(links, [key, ts]).select(key, F.col("__to").alias(ts)).distinct().join(kept, [key, ts], "left_anti")
        more = written(more, "kept")
        if more.isEmpty():
            break
        kept = kept.unionByName(more)
        links = written(links.join(links.select(key, F.col(ts).alias("__to"), F.col("__to").alias("__further")), [key, "__to"]).select(key, ts, F.col("__further").alias("__to")), "links")
    rows = times.join(kept, [key, ts], "left_semi").select(key, id_column)
    return df.join(rows, [key, id_column], "left_semi").select(*df.columns)


def decaying_max(df: DataFrame, key: str, step: str, prio: str, mult: float = 0.75, flat: float = 1.0, floor: float = 0.5, chunk: int | None = None) -> DataFrame:
    """Per key and step the best request, each earlier one having decayed by ``p * mult - flat`` a step.

    Decay rises with p, so it commutes with the maximum and needs no state: with
    ``c = flat / (1 - mult)``, ``p + c`` shrinks by ``mult`` a step, and its logarithm plus
    ``step * -log(mult)`` is constant. Decayed values at or below ``floor`` are dropped; a
    request in its own step never is. Priorities must exceed ``-c``.
    """
    c, slope = flat / (1 - mult), -F.log(F.lit(mult))
    best = df.groupBy(key, step).agg(F.max(prio).alias("own"))
    level = F.log(F.col("own") + c) + F.col(step) * slope
    if chunk is None:
        highest = F.max(level).over(W.partitionBy(key).orderBy(step).rowsBetween(W.unboundedPreceding, -1))
    else:
        best = _carry(_chunks(best, step, chunk), key, {"__before": (F.max(level), F.max)})
        highest = F.greatest(F.max(level).over(W.partitionBy(key, "__chunk").orderBy(step).rowsBetween(W.unboundedPreceding, -1)), F.col("__before"))
    old = F.exp(highest - F.col(step) * slope) - c
    return best.withColumn("old", old).select(key, step, F.greatest("own", F.when(F.col("old") > floor, F.col("old"))).alias("value"))


def emit_on_change(df: DataFrame, key: str, ts: str, id_column: str, cols: list[str]) -> DataFrame:
    """Keep a row only when it differs from the key's row before, by value; nulls are equal."""
    w = _past(key, ts, id_column)
    now = F.struct(*cols)
    return df.withColumn("__last", F.lag(now).over(w)).withColumn("__n", F.row_number().over(w)).filter((F.col("__n") == 1) | ~now.eqNullSafe(F.col("__last"))).drop("__last", "__n")


def stalled(df: DataFrame, key: str, ts: str, id_column: str, dist: str, timeout: int, chunk: int | None = None) -> DataFrame:
    """Add ``stalled``: the smallest distance so far has not improved for ``timeout``."""
    if chunk is not None:
        rows = _carry(_chunks(df, ts, chunk), key, {"__low": (F.min(dist), F.min)})
        own = _in_chunk(key, ts, id_column)
        best = F.least(F.min(dist).over(own.rowsBetween(W.unboundedPreceding, -1)), F.col("__low"))
        rows = rows.withColumn("__better", F.when(F.col(dist).isNotNull() & (best.isNull() | (F.col(dist) < best)), F.col(ts)))
        rows = _carry(rows, key, {"__before": (F.max("__better"), F.max)})
        since = F.coalesce(_last(F.col("__better")).over(own), F.col("__before"))
        return rows.select(*df.columns, F.coalesce(F.col(ts) - since >= timeout, F.lit(False)).alias("stalled"))
    w = _past(key, ts, id_column)
    best = F.min(dist).over(w.rowsBetween(W.unboundedPreceding, -1))
    better = df.withColumn("__better", F.col(dist).isNotNull() & (best.isNull() | (F.col(dist) < best)))
    since = F.last(F.when(F.col("__better"), F.col(ts)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return better.withColumn("stalled", F.coalesce(F.col(ts) - since >= timeout, F.lit(False))).drop("__better")


def idle_stages(df: DataFrame, key: str, ts: str, id_column: str, soft: int, hard: int) -> DataFrame:
    """Add ``gap`` to the key's next row and ``stage``: end past ``hard``, retarget past ``soft``, else keep; null for the last."""
    gap = F.lead(ts).over(_past(key, ts, id_column)) - F.col(ts)
    stage = F.when(F.col("gap") > hard, "end").when(F.col("gap") > soft, "retarget").when(F.col("gap").isNotNull(), "keep")
    return df.withColumn("gap", gap).withColumn("stage", stage)


def ramp(
    df: DataFrame, key: str, ts: str, id_column: str, reset: Column, p0: float, size: int, smallest: int, rate: float = 1.01, cap: float = 50.0, every: int = 240,
    chunk: int | None = None,
) -> DataFrame:
    """Updates since the last reset: ``update_no``, a growing ``priority``, a falling ``requested`` size, and whether it ``ended``.

    The priority grows by ``rate`` an update up to ``cap``. The size falls by one at an update
    more than ``every`` after the last fall (or the first update); below ``smallest`` it ends.
    """
    if chunk is not None:
        return _ramp_in_chunks(df, key, ts, id_column, reset, p0, size, smallest, rate, cap, every, chunk)
    w = _past(key, ts, id_column)
    island = df.withColumn("__island", F.sum(F.when(reset, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    own = W.partitionBy(key, "__island").orderBy(ts, id_column)
    falls = cooldown(island.select(F.struct(key, "__island").alias("__group"), key, ts, id_column), "__group", ts, id_column, every, strict=True)
    marked = island.join(falls.select(key, id_column, F.lit(1).alias("__fall")), [key, id_column], "left")
    requested = size + 1 - F.sum(F.coalesce("__fall", F.lit(0))).over(own)  # the first update counts no fall
    out = marked.withColumn("update_no", F.row_number().over(own) - 1).withColumn("requested", requested.cast("int"))
    out = out.withColumn("priority", F.least(F.lit(p0) * F.pow(F.lit(rate), F.col("update_no")), F.lit(cap))).withColumn("ended", F.col("requested") < smallest)
    return out.select(*df.columns, "update_no", "priority", "requested", "ended")


def _ramp_in_chunks(df: DataFrame, key: str, ts: str, id_column: str, reset: Column, p0: float, size: int, smallest: int, rate: float, cap: float, every: int, chunk: int) -> DataFrame:
    """``ramp`` by running counts of rows, resets and falls; an update's are those less what they were where its island began."""
    own, none = _in_chunk(key, ts, id_column), F.lit(0).cast("long")
    through = lambda column, before: F.sum(column).over(own) + F.coalesce(before, none)
    rows = _chunks(df.withColumn("__reset", F.coalesce(F.when(reset, 1), F.lit(0))), ts, chunk)
    rows = _carry(rows, key, {"__rows": (F.count("*"), F.sum), "__resets": (F.sum("__reset"), F.sum)})
    rows = rows.withColumn("__no", F.row_number().over(own.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce("__rows", none))
    rows = rows.withColumn("__island", through("__reset", F.col("__resets"))).drop("__rows", "__resets")
    falls = cooldown(rows.select(F.struct(key, "__island").alias("__group"), key, ts, id_column), "__group", ts, id_column, every, strict=True)
    rows = rows.join(falls.select(key, id_column, F.lit(1).alias("__fall")), [key, id_column], "left").withColumn("__fall", F.coalesce("__fall", F.lit(0)))
    rows = _carry(rows, key, {"__falls": (F.sum("__fall"), F.sum)})
    rows = rows.withColumn("__falls", through("__fall", F.col("__falls")))
    # Where an island begins: both counts only grow, so the last one is the largest.
    begin = F.when((F.col("__reset") == 1) | (F.col("__no") == 1), F.struct("__no", "__falls"))
    rows = _carry(rows.withColumn("__begin", begin), key, {"__before": (F.max("__begin"), F.max)})
    rows = rows.withColumn("__begin", F.coalesce(F.max("__begin").over(own), F.col("__before")))
    rows = rows.withColumn("update_no", (F.col("__no") - F.col("__begin.__no")).cast("int"))
    rows = rows.withColumn("requested", (size - (F.col("__falls") - F.col("__begin.__falls"))).cast("int"))
    rows = rows.withColumn("priority", F.least(F.lit(p0) * F.pow(F.lit(rate), F.col("update_no")), F.lit(cap))).withColumn("ended", F.col("requested") < smallest)
    return rows.select(*df.columns, "update_no", "priority", "requested", "ended")


def retry_exclusion(outcomes: DataFrame, key: str, reason: str, reasons: list[str], most: int = 3) -> DataFrame:
    """Per target the failures by reason, whether it is excluded (``most`` of either), and the escort level (losses of the first reason + 1)."""
    counts = outcomes.groupBy(key).pivot(reason, reasons).count().na.fill(0, reasons)
    excluded = F.greatest(*[F.col(r) for r in reasons]) >= most
    return counts.withColumn("excluded", excluded).withColumn("escort", F.col(reasons[0]) + 1)


#: Rows back to which ``halving_mean`` reads: what is further weighs less than a double of the sum can hold.
HALVINGS = 60


def halving_mean(df: DataFrame, key: str, ts: str, id_column: str, value: str) -> DataFrame:
    """Per key ``L += (v - L) / 2`` over its rows in order, from 0, and the number of rows.

    A row ``k`` places from the end weighs ``2^-(k+1)``. Only the last HALVINGS rows of a key
    are ranked (Spark keeps no more of a group in each task), all are counted.
    """
    k = F.row_number().over(W.partitionBy(key).orderBy(F.desc(ts), F.desc(id_column)))
    last = df.withColumn("__k", k).filter(F.col("__k") <= HALVINGS)
    level = last.groupBy(key).agg(F.sum(F.col(value) * F.pow(F.lit(0.5), F.col("__k"))).alias("level"))
    return level.join(df.groupBy(key).agg(F.count("*").alias("n")), key)


def group_lifecycle(df: DataFrame, name: str, ts: str, id_column: str, kind: str, starts: str, ends: str, reason: Column) -> DataFrame:
    """Intervals of named groups: a start counts only when none of the name is active; the next end closes it.

    Returned are name, start, end and the reason of the closing row (both null while open), and duration.
    """
    w = _past(name, ts, id_column)
    rows = df.filter(F.col(kind).isin(starts, ends))
    flips = rows.withColumn("__before", F.lag(kind).over(w)).filter((F.col(kind) == starts) & (F.col("__before").isNull() | (F.col("__before") == ends)) | (F.col(kind) == ends) & (F.col("__before") == starts))
    spans = flips.withColumn("end", F.lead(ts).over(w)).withColumn("reason", F.lead(reason).over(w)).filter(F.col(kind) == starts)
    return spans.select(name, F.col(ts).alias("start"), "end", (F.col("end") - F.col(ts)).alias("duration"), "reason")


def lifecycle_by_reason(spans: DataFrame) -> DataFrame:
    """Closed intervals by reason: how many, and their mean and longest duration."""
    closed = spans.filter(F.col("end").isNotNull())
    return closed.groupBy("reason").agg(F.count("*").alias("n"), F.avg("duration").alias("mean_duration"), F.max("duration").alias("longest"))


def per_period(df: DataFrame, ts: str, every: str, aggs: list[Column]) -> DataFrame:
    """Aggregates per tumbling period, with the period's start."""
    return df.groupBy(F.window(ts, every).alias("w")).agg(*aggs).withColumn("start", F.col("w.start")).drop("w")
