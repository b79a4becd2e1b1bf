"""Job rules on events, orders and line items."""

from pyspark.sql import functions as F

from ..operators import jobs as op
from .registry import query


@query("SELECT user_id, count(*) AS requests, bool_and(value >= 5) AS always_heavy, min(value) AS least_ms, CASE WHEN count(*) < 5 THEN 'omitted' WHEN bool_and(value >= 5) THEN 'detected' ELSE 'clean' END AS status FROM events GROUP BY ALL")
def job01_request_work(t):
    """JOB-01 on users: value as milliseconds."""
    return op.request_work(t.events, "user_id", "value", 5, 5)


@query("""WITH s AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT event_type, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM s GROUP BY event_type)
SELECT g.event_type, count(*) AS hours, count(*) FILTER (coalesce(n, 0) <= 0) AS idle_hours, max(coalesce(n, 0)) AS peak FROM g LEFT JOIN s ON g.event_type = s.event_type AND g.hour = s.hour GROUP BY g.event_type""")
def job03_idle_grid(t):
    """JOB-03 on event types: hours without events."""
    return op.idle_grid(t.events, "event_type", "ts", 0)


@query("""WITH s AS (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + 3 AS b FROM lineitem)
SELECT x.l_suppkey, x.l_partkey, x.l_orderkey AS a_l_orderkey, x.l_linenumber AS a_l_linenumber, y.l_orderkey AS b_l_orderkey, y.l_linenumber AS b_l_linenumber FROM s x JOIN s y ON x.l_suppkey = y.l_suppkey AND x.l_partkey = y.l_partkey
AND (x.l_orderkey < y.l_orderkey OR (x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber)) AND greatest(x.a, y.a) < least(x.b, y.b)""")
def job04_collisions(t):
    """JOB-04 on shipments: three days each, a pool for each supplier and part."""
    runs = t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship_start")).withColumn("ship_end", F.date_add("ship_start", 3))
    return op.collisions(runs, ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"], "ship_start", "ship_end")


@query("""WITH b AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN lag(o_orderstatus) OVER w = o_orderstatus THEN 0 ELSE 1 END AS brk FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
 i AS (SELECT o_custkey, sum(brk) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS island FROM b), g AS (SELECT o_custkey, island, count(*) AS n FROM i GROUP BY ALL)
SELECT o_custkey, max(n) AS longest, CAST(sum(n) AS BIGINT) AS runs, CASE WHEN max(n) >= 3 THEN 'detected' ELSE 'clean' END AS status FROM g GROUP BY ALL""")
def job05_repeats(t):
    """JOB-05 on customers: orders of unchanged status in a row."""
    return op.repeated_runs(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus", 3)


@query("""WITH p AS (SELECT user_id, CAST(ts AS DATE) AS slot, count(*) AS n, bool_or(event_type = 'error') AS failed FROM events GROUP BY ALL), a AS (SELECT user_id, max(n) AS peak, round(avg(n), 4) AS mean, bool_or(failed) AS failed FROM p GROUP BY ALL)
SELECT *, CASE WHEN peak >= 2.0 * mean AND failed THEN 'detected' ELSE 'clean' END AS status FROM a""")
def job06_no_decoupling(t):
    """JOB-06 on users: events a day, errors as failures."""
    return op.no_decoupling(t.events, "user_id", F.to_date("ts"), F.col("event_type") == "error", 2.0)
