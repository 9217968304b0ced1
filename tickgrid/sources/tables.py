"""Scans, the event stream and snapshot export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickgrid.sources.fixtures import event_time

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def scan_cells(df: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """All cells in a half-open rectangle; on stored columns the bounds reach the Parquet scan."""
    return df.filter((F.col("x") >= x0) & (F.col("x") < x0 + w) & (F.col("y") >= y0) & (F.col("y") < y0 + h))


def _woven(x: Column, y: Column) -> Column:
    """The bits of two numbers of at most 16 bits in turns: neighbours on the plane are mostly neighbours in this order."""
    bit = lambda c, i, to: F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long")), to)
    parts = [bit(c.cast("long"), i, 2 * i + k) for i in range(16) for k, c in enumerate((x, y))]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def store_cells(cells: DataFrame, path: str, side: int = 1024, files: int = 200, group_bytes: int = 8 << 20) -> None:
    """Write cells so that ``scan_stored`` reads little: a folder for each square of ``side`` cells, rows in it along a space-filling curve.

    A square's rows are dealt by ranges of the curve to at most ``files`` files over all squares, so a crowded
    one is several files; ``group_bytes`` bounds a row group, whose least and largest x and y Parquet keeps. ``side`` is at most 65,536.
    """
    places = {f"s{c}": F.floor(F.col(c) / side).cast("long") for c in "xy"}
    rows = cells.withColumns(places).withColumn("__curve", _woven(F.pmod("x", F.lit(side)), F.pmod("y", F.lit(side))))
    order = ["sx", "sy", "__curve"]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("__curve")
    dealt.write.mode("overwrite").option("parquet.block.size", group_bytes).partitionBy("sx", "sy").parquet(path)


def scan_stored(spark: SparkSession, path: str, x0: int, y0: int, w: int, h: int, side: int = 1024) -> DataFrame:
    """``scan_cells`` of a table of ``store_cells`` with the same ``side``: squares outside are no files to read, and bounds on x and y skip row groups."""
    inside = [F.col(f"s{c}").between(lo // side, (lo + n - 1) // side) for c, lo, n in (("x", x0, w), ("y", y0, h))]
    return scan_cells(spark.read.parquet(path).filter(inside[0] & inside[1]), x0, y0, w, h).drop("sx", "sy")


def scan_units(units: DataFrame, players: DataFrame, kinds: DataFrame, viewer: int, relation: str, pred: Column | None = None) -> DataFrame:
    """Units that ``viewer`` sees as ``self``, ``ally``, ``enemy`` or ``hostile``, narrowed by a predicate on kinds.

    ``hostile`` is whatever is neither own nor allied, neutral and unknown owners included; ``enemy``
    is a hostile combatant. A viewer that is no player has own units but no allies. Players are a
    small dimension and are broadcast when Spark's size threshold allows.
    """
    mine = players.filter(F.col("player") == viewer).select(F.col("team").alias("viewer_team"))
    known = players.select(F.col("player").alias("owner"), "team", "is_combatant", "is_neutral").join(F.broadcast(mine), F.lit(True), "left")
    same, allied = F.col("owner") == viewer, F.coalesce((F.col("team") == F.col("viewer_team")) & ~F.col("is_neutral"), F.lit(False))
    owners = lambda rule: known.filter(rule).select("owner")
    if relation == "self":
        out = units.filter(same)
    elif relation == "hostile":
        out = units.filter(F.coalesce(~same, F.lit(True))).join(owners(allied), "owner", "left_anti")
    elif relation in ("ally", "enemy"):
        out = units.join(owners(~same & (allied if relation == "ally" else ~allied & ~F.col("is_neutral") & F.col("is_combatant"))), "owner", "left_semi")
    else:
        raise ValueError(f"no relation {relation}")
    if pred is not None:
        out = out.join(kinds.filter(pred).select("kind_id"), "kind_id", "left_semi")
    return out.select(*units.columns)


def event_stream(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    """Event files as an unbounded table with event time; the schema is given, never inferred.

    ``files_per_batch`` bounds a micro-batch, and so the rows that a stateful operator holds of a key at once.
    """
    reader = spark.readStream.schema(schema)
    return event_time((reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path))


def export_snapshots(df: DataFrame, path: str, every: int) -> DataFrame:
    """Write rows of every ``every``-th tick by tag and tick; the written table is returned."""
    df.filter(F.col("tick") % every == 0).write.mode("overwrite").partitionBy("tag", "tick").parquet(path)
    return df.sparkSession.read.parquet(path).select(*df.columns)
