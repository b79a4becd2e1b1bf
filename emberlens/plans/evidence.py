"""Plan, span and source rules on small built-in evidence, which no driver table resembles."""

import json

from pyspark.sql import functions as F

from ..operators import query_plans, traces
from .registry import case, query

PLANS = [
    ("spill", [{"Plan": {"Node Type": "Sort", "Sort Key": ["a"], "Sort Space Used": 20480, "Sort Space Type": "Disk", "Actual Rows": 100000, "Actual Loops": 1, "Plans": [{"Node Type": "Seq Scan", "Relation Name": "items", "Filter": "(a > 5)", "Actual Rows": 100, "Actual Loops": 1, "Rows Removed by Filter": 99900, "Parent Relationship": "Outer"}]}}]),
    ("loop", [{"Plan": {"Node Type": "Nested Loop", "Actual Rows": 500, "Actual Loops": 1, "Plans": [{"Node Type": "Seq Scan", "Relation Name": "customers", "Actual Rows": 500, "Actual Loops": 1, "Parent Relationship": "Outer"}, {"Node Type": "Seq Scan", "Relation Name": "orders", "Filter": "(id = c.id)", "Actual Rows": 1, "Actual Loops": 500, "Rows Removed by Filter": 4999, "Parent Relationship": "Inner"}]}}]),
    ("fine", [{"Plan": {"Node Type": "Index Scan", "Relation Name": "orders", "Actual Rows": 1, "Actual Loops": 1}}]),
]


def _nodes(t):
    plans = t.spark.createDataFrame([(k, json.dumps(p)) for k, p in PLANS] + [("broken", "{")], "plan string, text string")
    return query_plans.nodes(plans, "plan", "text")


@case("SELECT * FROM (VALUES ('loop', '0.1', 'orders', 2500000.0::DOUBLE, 0.9998::DOUBLE), ('spill', '0.0', 'items', 100000.0::DOUBLE, 0.999::DOUBLE)) v(plan, node, relation, examined, removed_share)")
def db43_filtered_scans(t):
    """DB-43 on built-in plans."""
    return query_plans.wasteful_scans(_nodes(t), "plan", 10000, 0.9)


@case("SELECT * FROM (VALUES ('spill', '0', 20480.0::DOUBLE)) v(plan, node, space_kb)")
def db45_disk_sorts(t):
    """DB-45 on built-in plans."""
    return query_plans.disk_sorts(_nodes(t), "plan", 1024)


@case("SELECT * FROM (VALUES ('loop', '0.1', 'orders', 500.0::DOUBLE)) v(plan, node, relation, loops)")
def db46_inner_scans(t):
    """DB-46 on built-in plans."""
    return query_plans.inner_scans(_nodes(t), "plan", 100, 1000)


@query("""WITH RECURSIVE s AS (SELECT o_custkey AS t, o_orderkey AS s, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, o_orderpriority = '1-URGENT' AS w FROM orders),
 r AS (SELECT t, s, p, CASE WHEN w THEN s END AS owner FROM s WHERE p IS NULL UNION ALL SELECT s.t, s.s, s.p, CASE WHEN s.w THEN s.s ELSE r.owner END FROM s JOIN r ON s.t = r.t AND s.p = r.s)
SELECT t AS trace_id, s AS span_id, p AS parent_id, owner FROM r""")
def span_owners(t):
    """Nearest urgent order at or before each order of a customer: chains of spans, attributed to the nearest agent."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    spans = t.orders.select(F.col("o_custkey").alias("trace_id"), F.col("o_orderkey").alias("span_id"), F.lag("o_orderkey").over(w).alias("parent_id"), (F.col("o_orderpriority") == "1-URGENT").alias("wanted"))
    return traces.nearest_ancestor(spans, F.col("wanted")).select("trace_id", "span_id", "parent_id", "owner")


@query("""WITH s AS (SELECT l_orderkey AS t, l_linenumber AS s, CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 END AS p, l_tax >= 0.08 AS bad FROM lineitem), o AS (SELECT DISTINCT t FROM s WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s x WHERE x.t = s.t AND x.s = s.p)),
 k AS (SELECT t, 'malformed' AS reason FROM s WHERE bad UNION SELECT t, 'orphaned' FROM o) SELECT t AS trace_id, min(reason) AS reason FROM k GROUP BY t""")
def skipped_traces(t):
    """Orders as traces: one malformed or orphaned line item drops the whole trace, with a reason."""
    spans = t.lineitem.select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") - 1).alias("parent_id"), (F.col("l_tax") >= 0.08).alias("bad"))
    return traces.complete_traces(spans, bad=F.col("bad"))[1]
