"""Shared helpers: written intermediate tables and small column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickgrid.sources.shared import shared_dir

#: The white space that the text contracts name: space and U+0009 to U+000D.
WHITE_SPACE = r"[\x20\x09-\x0D]"


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; the table read back and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    It cuts the lineage and pins the rows: an executor lost later costs a read,
    not a recomputation.
    """
    return written_at(df, name)[0]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def plainly_named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc_id`` and ``text`` and all other columns called c0, c1, .., so that no name can clash or need quoting; ``toDF(*docs.columns)`` undoes it."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)])


#: Bits of the bitmap in ``may_hold``; at most 4 MB are broadcast, whatever the input.
FILTER_BITS = 1 << 25


def may_hold(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Mark whether a row's ``key`` may be among ``keys`` (a table with a column of that name).

    Returned is ``df`` with a boolean column ``may_hold``: false is certain, true is not.
    It rests on a broadcast bitmap of fixed size, so large rows need not be shuffled to
    find out that most of them have no partner.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = keys.select(F.bitmap_bucket_number(slot).alias("__bucket"), F.bitmap_bit_position(slot).alias("__bit"))
    bits = bits.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    out = df.withColumn("__bucket", F.bitmap_bucket_number(slot)).withColumn("__position", F.bitmap_bit_position(slot)).join(F.broadcast(bits), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.expr("cast(__position div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.floor(byte / F.pow(F.lit(2), F.col("__position") % 8)) % 2 == 1, F.lit(False))
    return out.withColumn("may_hold", found).drop("__bucket", "__position", "__bits")


#: Parts that the rows of one key are spread over in ``with_group``.
SALTS = 1024


def with_group(rows: DataFrame, key: str, spread: Column, values: dict[str, tuple[str, str]]) -> DataFrame:
    """Add to each row aggregates over all rows of its ``key``: ``{name: (function, column)}`` of min, max or sum.

    A key may hold any share of the rows: they are summed up in SALTS parts (by a hash of
    ``spread``), the parts' results are joined to their key's and those to the rows, so no
    task gets more than a part's rows or SALTS results of one key. Null keys group together.
    """
    parts = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    first = parts.groupBy(key, "__salt").agg(*[getattr(F, f)(c).alias(name) for name, (f, c) in values.items()])
    whole = first.groupBy(F.col(key).alias("__key")).agg(*[getattr(F, f)(name).alias(f"__{name}") for name, (f, _) in values.items()])
    told = first.select(F.col(key).alias("__own"), F.col("__salt").alias("__part")).join(whole, F.col("__own").eqNullSafe(F.col("__key"))).drop("__key")
    both = parts.join(told, F.col(key).eqNullSafe(F.col("__own")) & (F.col("__salt") == F.col("__part")))
    return both.select(*rows.columns, *[F.col(f"__{name}").alias(name) for name in values])


def with_facts(rows: DataFrame, key: str, spread: Column, facts: DataFrame) -> DataFrame:
    """Left join of ``rows`` to ``facts``, a table with one row per ``key``, whatever share of the rows one key holds.

    The facts of a key are first sent to the SALTS parts of it that occur (by a hash of
    ``spread``), then to the rows by key and part. A key or fact that is null has no partner.
    """
    parts = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    told = parts.select(key, "__salt").distinct().join(facts, key)
    return parts.join(told, [key, "__salt"], "left").drop("__salt")
