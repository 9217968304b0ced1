"""Grids with wide gaps, and cells stored along a curve: what is read and made goes by cells."""

from __future__ import annotations

import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tickgrid.operators import grid as G
from tickgrid.sources import tables as S

CELLS = "cell_id long, x int, y int, blocked boolean"


def test_distance_across_a_million_cells(spark):
    rnd = random.Random(2)
    rows = [(i, 1_000_000 * (i % 2) + rnd.randrange(30), -900_000 * (i % 2) + rnd.randrange(30), rnd.random() < 0.04) for i in range(400)]
    rows += [(900, -5_000_000, 7, False)]
    walls = [(x, y) for _, x, y, wall in rows if wall]
    want = {i: min(abs(x - a) + abs(y - b) for a, b in walls) for i, x, y, _ in rows}
    assert {r.cell_id: r.d for r in G.distance_to_blocked(spark.createDataFrame(rows, CELLS)).collect()} == want
    free = spark.createDataFrame([(i, x, y, False) for i, x, y, _ in rows], CELLS)
    assert {r.d for r in G.distance_to_blocked(free).collect()} == {None}


def test_both_ways_agree_on_a_ragged_grid(spark):
    rnd = random.Random(3)
    cells = spark.createDataFrame([(i, i % 20, i // 20, rnd.random() < 0.05) for i in range(390)], CELLS)
    assert sorted(map(tuple, G.distance_over_gaps(cells).collect())) == sorted(map(tuple, G.distance_to_blocked(cells).collect()))


def test_stored_cells_read_few_files_and_groups(spark, tmp_path):
    at = f"{tmp_path}/cells"
    cells = spark.range(256 * 256).select(F.col("id").alias("cell_id"), (F.col("id") % 256 - 100).cast("int").alias("x"), F.floor(F.col("id") / 256 - 50).cast("int").alias("y"))
    S.store_cells(cells, at, side=64, files=24, group_bytes=1 << 10)
    every = glob.glob(f"{at}/*/*/*.parquet")
    for x0, y0, w, h in ((-100, -50, 256, 256), (3, 5, 40, 30), (-70, -10, 20, 90), (63, 63, 2, 2), (900, 900, 5, 5)):
        out = S.scan_stored(spark, at, x0, y0, w, h, side=64)
        want = sorted(i for i in range(256 * 256) if x0 <= i % 256 - 100 < x0 + w and y0 <= i // 256 - 50 < y0 + h)
        assert sorted(r.cell_id for r in out.collect()) == want
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = S.scan_stored(spark, at, 3, 5, 40, 30, side=64)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(x,3)" in plan and "sx" in plan.split("PartitionFilters:")[1].split("]")[0]
    # The one square that holds the rectangle, and of its row groups those whose bounds meet it.
    files = [f for f in every if "/sx=0/sy=0/" in f]
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in files for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    bounds = lambda g, c: next(g.column(k).statistics for k in range(g.num_columns) if g.column(k).path_in_schema == c)
    met = [g for g in groups if bounds(g, "x").max >= 3 and bounds(g, "x").min < 43 and bounds(g, "y").max >= 5 and bounds(g, "y").min < 35]
    assert 0 < len(files) <= len(every) / 10 and len(met) < len(groups)
