"""One key that holds the whole table: lifted cooldowns and two-level scans against plain folds and windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tickgrid.operators import temporal as T


def _kept(times, gap, strict):
    kept, last = [], None
    for t, i in sorted(times):
        if last is None or (t - last > gap if strict else t - last >= gap):
            kept.append(i)
            last = t
    return kept


@pytest.mark.parametrize("strict", [False, True])
def test_lifted_cooldown_equals_fold(spark, strict):
    rnd = random.Random(5)
    spans = {1: 400, 2: 3_000, 3: 60, 4: 0, -5: 90_000}
    rows = [(k, rnd.randint(-span, span), 10_000 * i + j) for i, (k, span) in enumerate(spans.items()) for j in range(250)]
    df = spark.createDataFrame(rows + [(9, None, 1), (None, 3, 2)], "key long, tick long, id long")
    for gap in (1, 7, 64):
        want = sorted(i for k in spans for i in _kept([(t, i) for key, t, i in rows if key == k], gap, strict))
        assert sorted(r.id for r in T.cooldown(df.filter("key is not null and tick is not null"), "key", "tick", "id", gap, strict, fold=100).collect()) == want
    halves = df.filter("tick is not null").withColumn("tick", F.col("tick") / 2)
    got = T.cooldown(halves, "key", "tick", "id", 7, strict, fold=0)
    assert sorted(r.id for r in got.collect()) == sorted(i for k in spans for i in _kept([(t / 2, i) for key, t, i in rows if key == k], 7, strict))
    assert T.cooldown(df.limit(0), "key", "tick", "id", 3, strict, fold=0).count() == 0
    with pytest.raises(ValueError):
        T.cooldown(df, "key", "tick", "id", 0)


def test_cooldown_of_a_key_that_never_pauses(spark):
    n, gap = 1_000_000, 700
    df = spark.range(n).select(F.lit(1).alias("key"), (F.col("id") + F.pmod(F.hash("id"), F.lit(3))).alias("tick"), "id")
    got = [r.id for r in T.cooldown(df, "key", "tick", "id", gap).collect()]
    assert sorted(got) == sorted(_kept([(r.tick, r.id) for r in df.toLocalIterator()], gap, False)) and len(got) > 1_000


def _history(spark):
    rnd = random.Random(11)
    rows = [(1 if i % 50 else 2, rnd.randint(0, 9_000), i, rnd.choice([None, rnd.uniform(0, 100)])) for i in range(3_000)]
    rows += [(None, 5, 5_000 + i, 50.0 * i) for i in range(4)] + [(7, 1, 6_000, 1.0)]
    return spark.createDataFrame(rows, "key long, tick long, id long, value double").repartition(4)


@pytest.mark.parametrize("chunk", [1, 500, 100_000])
def test_scans_in_chunks_equal_windows(spark, chunk):
    df = _history(spark)
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    enter, stay = F.col("value") >= 70, F.col("value") >= 30
    whole = T.hysteresis(df, "key", "tick", "id", enter, stay)
    assert rows(T.hysteresis(df, "key", "tick", "id", enter, stay, chunk)) == rows(whole) and whole.filter("active").count() > 100
    assert rows(T.stalled(df, "key", "tick", "id", "value", 900, chunk)) == rows(T.stalled(df, "key", "tick", "id", "value", 900))
    level = lambda c: T.decaying_max(df, "key", "tick", "value", 0.999, 0.01, chunk=c).withColumn("value", F.round("value", 6))
    assert rows(level(chunk)) == rows(level(None))
    known = df.filter("key is not null")
    ramp = lambda c: T.ramp(known, "key", "tick", "id", F.col("value") > 98, 5.0, 12, 6, chunk=c).withColumn("priority", F.round("priority", 9))
    assert rows(ramp(chunk)) == rows(ramp(None))


def test_chunks_deal_one_key_to_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("key"), F.col("id").alias("tick"), "id", (F.col("id") * 37 % 101).cast("double").alias("value"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = lambda chunk: len(T.hysteresis(df, "key", "tick", "id", F.col("value") >= 70, F.col("value") >= 30, chunk).select("active", F.spark_partition_id().alias("p")).groupBy("p").agg(F.max("active")).collect())
        assert (out(None), out(500)) == (1, 4)  # the session's number of shuffle partitions
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
