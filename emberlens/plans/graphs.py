"""Dependency and call graphs on orders, line items and suppliers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs as op
from .registry import query

# a customer's orders as requests of a capture; a large line item waits for the customer's order at the place that its supplier names
SQL_REQUESTS = """o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place, o_orderstatus || o_orderpriority AS key, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders),
 r AS (SELECT o_custkey, place, key, day AS first, day + o_orderkey % 5 AS last, o_orderstatus = 'P' AS exempt, o_custkey % 10 <> 0 AS reviewed FROM o),
 d AS (SELECT DISTINCT o_custkey, place, l_suppkey % 14 + 1 AS after_place FROM lineitem JOIN o ON o_orderkey = l_orderkey WHERE l_quantity >= 46)"""


def _requests(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long")
    orders = t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("id"), F.concat("o_orderstatus", "o_orderpriority").alias("key"), day.alias("begin"), (day + F.col("o_orderkey") % 5).alias("end"), (F.col("o_orderstatus") == "P").alias("exempt"), (F.col("o_custkey") % 10 != 0).alias("reviewed"))
    waits = t.lineitem.where("l_quantity >= 46").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "id", (F.col("l_suppkey") % 14 + 1).alias("after_id")).distinct()
    return orders, waits


@query(f"""WITH RECURSIVE {SQL_REQUESTS},
 x AS (SELECT o_custkey, place, after_place FROM d UNION SELECT x.o_custkey, x.place, d.after_place FROM x JOIN d ON d.o_custkey = x.o_custkey AND d.place = x.after_place),
 cyclic AS (SELECT DISTINCT o_custkey FROM x WHERE place = after_place), missing AS (SELECT DISTINCT o_custkey FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.o_custkey = d.o_custkey AND r.place = d.after_place)),
 refused AS (SELECT o_custkey, 'missing dependency' AS refused FROM missing UNION ALL SELECT o_custkey, 'cyclic dependency' FROM cyclic WHERE o_custkey NOT IN (SELECT o_custkey FROM missing)),
 p AS (SELECT o_custkey, place, last - first AS total FROM r WHERE o_custkey NOT IN (SELECT o_custkey FROM refused) UNION ALL SELECT p.o_custkey, d.place, p.total + r.last - r.first FROM p JOIN d ON d.o_custkey = p.o_custkey AND d.after_place = p.place JOIN r ON r.o_custkey = d.o_custkey AND r.place = d.place),
 critical AS (SELECT o_custkey, max(total) AS critical FROM p GROUP BY ALL),
 f AS (SELECT r.*, NOT EXISTS (SELECT 1 FROM d WHERE d.o_custkey = r.o_custkey AND d.place = r.place) AS free FROM r WHERE NOT exempt),
 fam AS (SELECT o_custkey, count(*) FILTER (n >= 3 AND every) AS duplicates FROM (SELECT o_custkey, key, count(*) AS n, bool_and(free) AS every FROM f GROUP BY ALL) GROUP BY ALL),
 s AS (SELECT o_custkey, count(*) AS independent, count(*) FILTER (near) AS hits FROM (SELECT o_custkey, first < lag(last) OVER (PARTITION BY o_custkey ORDER BY first, place) + 20 AS near FROM f WHERE free) GROUP BY ALL),
 g AS (SELECT o_custkey, count(*) AS requests, bool_and(reviewed) AS reviewed FROM r GROUP BY ALL),
 a AS (SELECT g.o_custkey, requests, refused, coalesce(duplicates, 0) AS duplicates, coalesce(independent, 0) AS independent, CAST(critical AS DOUBLE) AS critical,
  CASE WHEN refused IS NOT NULL THEN NULL WHEN coalesce(duplicates, 0) > 0 THEN 'duplicate' WHEN coalesce(independent, 0) >= 2 AND hits = 0 AND reviewed THEN 'independent waterfall' END AS finding
  FROM g LEFT JOIN refused USING (o_custkey) LEFT JOIN fam USING (o_custkey) LEFT JOIN s USING (o_custkey) LEFT JOIN critical USING (o_custkey))
SELECT *, CASE WHEN refused IS NOT NULL THEN 'omitted' WHEN finding IS NOT NULL THEN 'detected' ELSE 'clean' END AS status FROM a""")
def net11_captures(t):
    """NET-11 on customers: orders as requests, large line items as what they wait for."""
    requests, waits = _requests(t)
    return op.browser_fetches(requests, waits, "o_custkey", 3, 20)


@query(f"""WITH RECURSIVE {SQL_REQUESTS},
 x AS (SELECT o_custkey, place, after_place FROM d UNION SELECT x.o_custkey, x.place, d.after_place FROM x JOIN d ON d.o_custkey = x.o_custkey AND d.place = x.after_place),
 stuck AS (SELECT o_custkey, place FROM x WHERE place = after_place UNION SELECT o_custkey, place FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.o_custkey = d.o_custkey AND r.place = d.after_place)),
 b AS (SELECT o_custkey, place FROM stuck UNION SELECT x.o_custkey, x.place FROM x JOIN stuck ON stuck.o_custkey = x.o_custkey AND stuck.place = x.after_place),
 p AS (SELECT o_custkey, place, 0 AS level, last - first AS total FROM r WHERE (o_custkey, place) NOT IN (SELECT (o_custkey, place) FROM b) UNION ALL SELECT p.o_custkey, d.place, p.level + 1, p.total + r.last - r.first FROM p JOIN d ON d.o_custkey = p.o_custkey AND d.after_place = p.place JOIN r ON r.o_custkey = d.o_custkey AND r.place = d.place WHERE (d.o_custkey, d.place) NOT IN (SELECT (o_custkey, place) FROM b))
SELECT r.o_custkey, r.place AS id, max(p.level) AS level, CAST(max(total) AS DOUBLE) AS finish, max(p.level) IS NULL AS blocked FROM r LEFT JOIN p ON p.o_custkey = r.o_custkey AND p.place = r.place GROUP BY r.o_custkey, r.place""")
def dependency_levels(t):
    """Levels and longest chains of every request, and those that a cycle or a missing one blocks."""
    requests, waits = _requests(t)
    nodes = requests.select("o_custkey", "id", (F.col("end") - F.col("begin")).cast("double").alias("took"))
    return op.peel(nodes, waits, ["o_custkey", "id"], "took").drop("took")


# suppliers as functions: the supplier of a line item calls that of the order's next one where the item is large
SQL_CALLS = """n AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, l_quantity FROM lineitem), e AS (SELECT DISTINCT src, dst FROM n WHERE dst IS NOT NULL AND l_quantity >= 50 AND src <> dst),
 entries AS (SELECT s_suppkey AS node, CASE WHEN s_nationkey % 2 = 0 THEN 'handler' ELSE 'loop' END AS kind FROM supplier WHERE s_acctbal > 8500), cached AS (SELECT s_suppkey AS node FROM supplier WHERE s_nationkey IN (3, 8, 11, 12, 17, 19, 20, 23))"""


def _calls(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = t.lineitem.select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst"), "l_quantity")
    edges = pairs.where("dst IS NOT NULL AND l_quantity >= 50 AND src != dst").select("src", "dst").distinct()
    entries = t.supplier.where("s_acctbal > 8500").select(F.col("s_suppkey").alias("node"), F.when(F.col("s_nationkey") % 2 == 0, "handler").otherwise("loop").alias("kind"))
    return edges, entries, t.supplier.where("s_nationkey IN (3, 8, 11, 12, 17, 19, 20, 23)").select(F.col("s_suppkey").alias("node"))


@query(f"""WITH RECURSIVE {SQL_CALLS}, open AS (SELECT * FROM entries WHERE node NOT IN (SELECT node FROM cached)),
 b AS (SELECT node, 0 AS hops, node AS entry FROM open UNION SELECT e.dst, b.hops + 1, b.entry FROM b JOIN e ON e.src = b.node WHERE b.hops < 40 AND e.dst NOT IN (SELECT node FROM cached)),
 m AS (SELECT node, min(hops) AS hops FROM b GROUP BY node), k AS (SELECT m.node, m.hops, min(entry) AS entry FROM m JOIN b ON b.node = m.node AND b.hops = m.hops GROUP BY ALL)
SELECT s_suppkey AS id, s_suppkey AS node, k.entry, kind, hops, CASE WHEN hops IS NOT NULL AND s_acctbal < 5000 THEN 'detected' ELSE 'clean' END AS status FROM supplier LEFT JOIN k ON k.node = s_suppkey LEFT JOIN entries ON entries.node = k.entry""")
def llm02_repeated(t):
    """LLM-02 on suppliers: rich ones are entry points, some nations hold a cache, poor ones send a fixed request."""
    edges, entries, cached = _calls(t)
    calls = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("node"), (F.col("s_acctbal") < 5000).alias("fixed"))
    return op.repeated_calls(calls, edges, entries, cached)


@query(f"""WITH RECURSIVE {SQL_CALLS}, c AS (SELECT node AS entry, node FROM entries UNION SELECT c.entry, e.dst FROM c JOIN e ON e.src = c.node)
SELECT entry, count(*) AS reached FROM c GROUP BY ALL""")
def call_closure(t):
    """How many functions each entry point reaches, itself included: the closure of the call edges."""
    edges, entries, _ = _calls(t)
    return op.reached_counts(edges, entries)
