"""Profile rules on shipped quantities."""

from pyspark.sql import functions as F

from ..operators import profiles as op
from .registry import query

SQL_STACKS = "s AS (SELECT r_name, n_name, l_returnflag, l_suppkey, l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH {SQL_STACKS}, f AS (SELECT l_returnflag AS profile, r_name AS function, l_quantity AS w, 0.0 AS leaf, l_quantity AS root FROM s UNION ALL SELECT l_returnflag, n_name, l_quantity, 0.0, 0.0 FROM s UNION ALL SELECT l_returnflag, 'supplier ' || l_suppkey, l_quantity, l_quantity, 0.0 FROM s),
 a AS (SELECT profile, function, sum(w) AS inclusive, sum(leaf) AS self, sum(root) AS root FROM f GROUP BY ALL), t AS (SELECT l_returnflag AS profile, sum(l_quantity) AS total FROM s GROUP BY ALL)
SELECT a.*, total, CASE WHEN total < 1000 THEN 'omitted' WHEN self > 0.01 * total OR (inclusive > 0.15 * total AND root = 0 AND inclusive <= 0.9 * total) THEN 'detected' ELSE 'clean' END AS status FROM a JOIN t USING (profile)""")
def obs19_hotspots(t):
    """OBS-19 CPU: a stack of region, nation and supplier, quantity as weight, a profile for each return flag."""
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    stacks = rows.groupBy(F.col("l_returnflag").alias("profile"), F.array("r_name", "n_name", F.concat(F.lit("supplier "), "l_suppkey")).alias("frames")).agg(F.sum("l_quantity").alias("weight"))
    return op.hotspots(stacks, "profile", "frames", "weight", min_self=0.01, min_inclusive=0.15)


@query("""WITH m AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
 r AS (SELECT *, lag(v) OVER w AS before, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM m WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)),
 a AS (SELECT l_suppkey, count(*) AS snapshots, arg_min(v, i) AS first, arg_max(v, i) AS last, arg_max(v, CASE WHEN i <= (n + 1) / 2 THEN i END) AS middle, count(*) FILTER (v >= before) AS rising FROM r GROUP BY ALL)
SELECT l_suppkey, snapshots, round(last - first, 2) AS growth, rising, CASE WHEN snapshots < 5 THEN 'omitted' WHEN last - first >= 10 AND rising >= 0.5 * (snapshots - 1) AND 2 * (last - middle) >= (last - first) * 0.5 THEN 'detected' ELSE 'clean' END AS status FROM a""")
def obs19_leak(t):
    """OBS-19 memory: a supplier's monthly quantity as snapshots."""
    months = t.lineitem.groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month")).agg(F.sum("l_quantity").alias("v"))
    return op.leaks(months, ["l_suppkey"], "month", "v", 10, min_monotonic=0.5)


@query("""WITH t AS (SELECT l_partkey, sum(l_quantity) AS total FROM lineitem GROUP BY ALL), c AS (SELECT p_partkey AS l_partkey, p_size % 5 + 1 AS first, p_size % 5 + 3 AS last FROM part),
 g AS (SELECT l_partkey, first, last, sum(l_quantity) AS weight FROM c JOIN lineitem USING (l_partkey) WHERE l_linenumber BETWEEN first AND last GROUP BY ALL),
 h AS (SELECT l_partkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_linenumber) AS n FROM c JOIN lineitem USING (l_partkey) WHERE l_linenumber BETWEEN first AND last)
SELECT g.l_partkey, first, last, weight, total, l_linenumber AS heaviest_line, CASE WHEN weight >= 0.5 * total THEN 'detected' ELSE 'clean' END AS status FROM g JOIN t USING (l_partkey) JOIN h ON g.l_partkey = h.l_partkey AND h.n = 1""")
def profile_line_shares(t):
    """PY-01 on parts: a part as file, line numbers as lines, a span of three lines as candidate."""
    candidates = t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 5 + 1).alias("first"), (F.col("p_size") % 5 + 3).alias("last"))
    return op.line_shares(candidates, t.lineitem.select("l_partkey", "l_linenumber", "l_quantity"), "l_partkey", "first", "last", "l_linenumber", "l_quantity", 0.5)
