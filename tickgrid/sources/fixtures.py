"""Entity-shaped views over the benchmark tables, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whole minutes since the start of the event table, in Spark and in DuckDB.
TICK = {
    "spark": "timestampdiff(MINUTE, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)",
    "duckdb": "date_diff('minute', TIMESTAMP '2024-01-01 00:00:00', ts)",
}

#: View name -> the table it scans most of, and its SQL; ``{tick}`` differs by dialect.
VIEWS = {
    "v_cells": "SELECT o_orderkey AS cell_id, CAST(o_orderkey % 128 AS INT) AS x, CAST(FLOOR(o_orderkey / 128.0) AS INT) AS y, o_orderpriority AS terrain, o_orderstatus = 'F' AS visible, o_totalprice < 5000 AS blocked, o_totalprice AS amount, o_orderdate AS updated FROM orders",
    "v_units": "SELECT ((l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS unit_id, CAST(s_nationkey AS INT) AS owner, l_partkey AS kind_id, CAST(l_orderkey % 128 AS INT) AS x, CAST(FLOOR(l_orderkey / 128.0) AS INT) AS y, CAST(l_quantity AS DOUBLE) AS hp, CAST(50 AS DOUBLE) AS max_hp, l_returnflag AS stance, l_linestatus AS zone FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "v_players": "SELECT CAST(n_nationkey AS INT) AS player, CAST(n_regionkey AS INT) AS team, n_nationkey % 5 <> 4 AS is_combatant, n_nationkey = 24 AS is_neutral, CAST((n_nationkey * 37) % 128 AS INT) AS x, CAST((n_nationkey * 5) % 100 AS INT) AS y FROM nation",
    "v_kinds": "SELECT p_partkey AS kind_id, p_name AS name, p_type AS class, p_brand AS family, CAST(p_retailprice AS DOUBLE) AS cost, CAST(CASE WHEN p_partkey % 30 < 25 THEN p_partkey % 30 END AS INT) AS primary_w, CAST(CASE WHEN p_partkey % 3 <> 0 THEN p_size % 25 END AS INT) AS secondary_w FROM part",
    "v_weapons": "SELECT CAST(n_nationkey AS INT) AS weapon_id, CAST(n_regionkey AS INT) AS projectile_id, CAST((n_nationkey * 13) % 60 AS DOUBLE) AS damage, CAST(n_nationkey % 9 AS DOUBLE) AS range, CAST((n_nationkey * 7) % 20 AS DOUBLE) AS rof FROM nation",
    "v_projectiles": "SELECT CAST(r_regionkey AS INT) AS projectile_id, r_regionkey % 2 = 0 AS anti_ground, r_regionkey >= 3 AS anti_air FROM region",
    "v_events": "SELECT event_id, ts, {tick} AS tick, user_id AS key, event_type AS kind, value FROM events",
    "v_requests": "SELECT event_id AS request_id, ts, {tick} AS tick, user_id % 20 AS requester, event_type AS item, value AS priority FROM events",
}

_TABLES = ("region", "nation", "supplier", "part", "orders", "lineitem", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view. Only the tables it names are read; unused columns are pruned."""
    sql = VIEWS[name].format(tick=TICK["spark"])
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f" {t}" in f" {sql} ".replace(",", " ")}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(sql, **{t: df for t, df in used.items() if f"{{{t}}}" in sql})


def duckdb_views(sql: str) -> str:
    """``sql`` with a WITH clause for each fixture view that it names."""
    names = [n for n in VIEWS if n in sql]
    heads = [f"{n} AS ({VIEWS[n].format(tick=TICK['duckdb'])})" for n in names]
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = body.split(None, 2 if recursive else 1)[-1]
        return f"WITH {'RECURSIVE ' * recursive}{', '.join(heads)}, {body}" if heads else sql
    return f"WITH {', '.join(heads)} {body}" if heads else sql


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """The column as TIMESTAMP, which watermarks need; the session's time zone should be UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))
