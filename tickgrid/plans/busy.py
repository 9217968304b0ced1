"""Queries in which all events are one key's: the forms of the history operators that spread a busy key over many tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickgrid.operators import temporal as T
from tickgrid.sources.fixtures import duckdb_views, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: All events under one key.
_ONE = "e AS (SELECT event_id, tick, 0 AS key, value FROM v_events)"


def query(sql: str):
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(view(spark, sf_dir, "v_events").withColumn("key", F.lit(0)))
        ORACLE_SQL[f.__name__] = duckdb_views(sql)
        return f

    return add


@query(f"WITH {_ONE} SELECT event_id, coalesce(last_value(CASE WHEN value >= 90 THEN true WHEN value < 10 THEN false END IGNORE NULLS) OVER (ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING), false) AS active FROM e")
def t1_hysteresis_one_key(events):
    return T.hysteresis(events, "key", "tick", "event_id", F.col("value") >= 90, F.col("value") >= 10, chunk=1440).select("event_id", "active")


@query(f"""WITH RECURSIVE {_ONE}, k(tick) AS (SELECT min(tick) FROM e UNION ALL SELECT min(e.tick) FROM k JOIN e ON e.tick >= k.tick + 120 HAVING min(e.tick) IS NOT NULL)
    SELECT min(e.event_id) AS event_id, k.tick FROM k JOIN e ON e.tick = k.tick GROUP BY k.tick""")
def t3_cooldown_one_key(events):
    return T.cooldown(events, "key", "tick", "event_id", 120, fold=1_000).select("event_id", "tick")


@query(f"""WITH {_ONE}, b AS (SELECT tick // 60 AS hour, max(value) AS own FROM e GROUP BY 1),
    o AS (SELECT *, exp(max(ln(own + 4) - hour * ln(0.75)) OVER (ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + hour * ln(0.75)) - 4 AS old FROM b)
    SELECT hour, round(greatest(own, CASE WHEN old > 0.5 THEN old END) + 0.0000123, 3) AS value FROM o""")
def t4_decaying_max_one_key(events):
    out = T.decaying_max(events.withColumn("hour", F.expr("tick div 60")), "key", "hour", "value", chunk=24)
    return out.select("hour", F.round(F.col("value") + 0.0000123, 3).alias("value"))


@query(f"""WITH {_ONE}, b AS (SELECT *, min(value) OVER (ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e),
    s AS (SELECT *, last_value(CASE WHEN value IS NOT NULL AND (best IS NULL OR value < best) THEN tick END IGNORE NULLS) OVER (ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING) AS since FROM b)
    SELECT event_id, coalesce(tick - since >= 4320, false) AS stalled FROM s""")
def t6_stalled_one_key(events):
    return T.stalled(events, "key", "tick", "event_id", "value", 4320, chunk=1440).select("event_id", "stalled")


@query(f"""WITH RECURSIVE {_ONE}, i AS (SELECT *, sum(CASE WHEN value > 99 THEN 1 ELSE 0 END) OVER (ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e),
    n AS (SELECT island, tick, event_id, row_number() OVER (PARTITION BY island ORDER BY tick, event_id) AS n FROM i),
    w(island, n, last, size, event_id) AS (SELECT island, n, tick, 12, event_id FROM n WHERE n = 1 UNION ALL
      SELECT n.island, n.n, CASE WHEN n.tick > w.last + 240 THEN n.tick ELSE w.last END, CASE WHEN n.tick > w.last + 240 THEN w.size - 1 ELSE w.size END, n.event_id FROM w JOIN n ON n.island = w.island AND n.n = w.n + 1)
    SELECT event_id, CAST(n - 1 AS INT) AS update_no, round(least(5.0 * pow(1.01, n - 1), 50.0), 6) AS priority, size AS requested, size < 6 AS ended FROM w""")
def t8_ramp_one_key(events):
    out = T.ramp(events, "key", "tick", "event_id", F.col("value") > 99, 5.0, 12, 6, chunk=1440)
    return out.select("event_id", "update_no", F.round("priority", 6).alias("priority"), "requested", "ended")
