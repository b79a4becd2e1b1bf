"""CI rules on orders (runs) and line items (attempts)."""

from pyspark.sql import functions as F

from ..operators import ci as op
from .registry import query

SQL_ATTEMPTS = "a AS (SELECT l_orderkey AS run, l_linenumber AS attempt, l_partkey AS sha, l_suppkey AS workflow, CASE l_returnflag WHEN 'A' THEN 'failure' WHEN 'R' THEN 'cancelled' ELSE 'success' END AS conclusion FROM lineitem), w AS (SELECT a.run, attempt, sha, o_orderpriority AS workflow, conclusion FROM a JOIN orders ON run = o_orderkey), p AS (SELECT *, lag(conclusion) OVER (PARTITION BY run ORDER BY attempt, sha, conclusion) AS before FROM w)"


def _attempts(t):
    c = F.when(F.col("l_returnflag") == "A", "failure").when(F.col("l_returnflag") == "R", "cancelled").otherwise("success")
    items = t.lineitem.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("attempt"), F.col("l_partkey").alias("sha"), c.alias("conclusion"))
    return items.join(t.orders.select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("workflow")), "run")


@query(f"""WITH {SQL_ATTEMPTS}, s AS (SELECT workflow, sha, count(*) FILTER (before = 'failure') AS rechecks FROM p GROUP BY ALL)
SELECT workflow, max(rechecks) AS max_rechecks, CAST(sum(rechecks) AS BIGINT) AS rechecks, CASE WHEN max(rechecks) >= 2 THEN 'detected' ELSE 'clean' END AS status, CASE WHEN max(rechecks) >= 4 THEN 'high' WHEN max(rechecks) >= 2 THEN 'medium' END AS confidence FROM s GROUP BY workflow""")
def ci01_rechecks(t):
    """CI-01: order priority as workflow, part as sha."""
    return op.rechecks(_attempts(t), "workflow", "sha", "run", ["attempt", "sha", "conclusion"], "conclusion")


@query(f"""WITH {SQL_ATTEMPTS}, s AS (SELECT workflow, run, bool_or(before = 'failure' AND conclusion = 'failure') AS blind FROM p GROUP BY ALL)
SELECT workflow, count(*) AS runs, count(*) FILTER (blind) AS blind_runs, CASE WHEN count(*) FILTER (blind) >= 2 THEN 'detected' ELSE 'clean' END AS status FROM s GROUP BY workflow""")
def ci02_blind_rechecks(t):
    """CI-02: failed again right after a failure."""
    return op.blind_rechecks(_attempts(t), "workflow", "run", ["attempt", "sha", "conclusion"], "conclusion")


def _sql_flaky(by, least):
    return f"""WITH {SQL_ATTEMPTS}, f AS (SELECT {by}, run, max(CASE WHEN conclusion = 'success' THEN attempt END) > min(CASE WHEN conclusion = 'failure' THEN attempt END) AS flaky FROM w GROUP BY ALL),
 c AS (SELECT {by}, count(*) AS runs, count(*) FILTER (flaky) AS flaky_runs FROM f GROUP BY ALL)
SELECT *, CASE WHEN runs < 5 THEN 'omitted' WHEN flaky_runs >= {least} THEN 'detected' ELSE 'clean' END AS status, CASE WHEN flaky_runs >= {least} AND 4 * flaky_runs >= runs THEN 'high' WHEN flaky_runs >= {least} THEN 'medium' END AS confidence FROM c"""


@query(_sql_flaky("sha", 2))
def ci03_flaky_jobs(t):
    """CI-03: a part as job, failed and then passed within a run."""
    return op.flaky(_attempts(t), "sha", "run", "attempt", "conclusion", 2)


@query(_sql_flaky("workflow", 3))
def ci05_brown_builds(t):
    """CI-05: runs of a workflow that failed and then passed."""
    return op.flaky(_attempts(t), "workflow", "run", "attempt", "conclusion", 3)


@query("""WITH r AS (SELECT o_custkey, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = o_orderpriority AS same FROM orders)
SELECT o_custkey, count(*) AS runs, count(*) FILTER (same) AS unchanged, CASE WHEN count(*) FILTER (same) >= 3 THEN 'detected' ELSE 'clean' END AS status FROM r GROUP BY ALL""")
def ci12_unchanged(t):
    """CI-12: a customer's orders as scheduled runs, the priority as sha."""
    return op.unchanged_schedules(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority")


@query("""WITH j AS (SELECT l_orderkey, l_linenumber AS job, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS a, CAST(floor(epoch(l_shipdate)) AS BIGINT) + 86400 * 7 AS b FROM lineitem)
SELECT x.job AS job_a, y.job AS job_b, count(*) AS runs, round(median(y.b - x.a), 4) AS median_seconds, CASE WHEN median(y.b - x.a) >= 1500000 THEN 'detected' ELSE 'clean' END AS status
FROM j x JOIN j y USING (l_orderkey) WHERE x.job <> y.job AND y.a - x.b BETWEEN 0 AND 864000 GROUP BY ALL""")
def ci18_chains(t):
    """CI-18: line items as jobs of a week."""
    start = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    jobs = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("job"), start.alias("a"), (start + 86400 * 7).alias("b"))
    return op.chains(jobs, "l_orderkey", "job", "a", "b", 864000, 1500000)


SQL_RANGES = ", ".join(
    f"round({wh}, 3) AS wh_{n}, round({wh} * {op.CARBON_KG_PER_KWH[i]}, 3) AS co2e_g_{n}, round({wh} / {op.PUE[i]} * {op.WATER_ON_SITE} + {wh} * {round(op.WATER_OFF_SITE[i] * op.LITRES_PER_GALLON, 4)}, 3) AS water_ml_{n}"
    for i, n in enumerate(("low", "high"))
    for wh in [f"(CASE WHEN ok THEN s / 3600.0 * {op.WATTS_PER_VCPU[i]} * {op.PUE[i]} END)"]
)


@query(f"WITH g AS (SELECT l_suppkey, count(*) AS jobs, bool_and(l_tax < 0.08) AS ok, CAST(sum(l_quantity * 60) AS DOUBLE) AS s FROM lineitem GROUP BY ALL) SELECT l_suppkey, jobs, {SQL_RANGES} FROM g")
def ci_impact_ranges(t):
    """Energy ranges of suppliers' jobs: quantity as minutes; the highest tax stands for an unknown runner."""
    return op.impact_ranges(t.lineitem.withColumn("seconds", F.col("l_quantity") * 60), ["l_suppkey"], "seconds", F.col("l_tax") < 0.08)


@query("""WITH g AS (SELECT o_custkey, count(*) AS runs, count(*) FILTER (o_orderstatus <> 'P') AS executed, count(CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 3 = 0 THEN 1 END) AS sampled, CAST(sum(CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) END) AS BIGINT) AS m FROM orders GROUP BY ALL)
SELECT o_custkey, runs, executed, sampled, CASE WHEN executed = 0 THEN 0.0 WHEN sampled > 0 THEN round(m * executed / CAST(sampled AS DOUBLE), 2) END AS estimate FROM g""")
def ci_impact_summary(t):
    """Estimates of customers' runs: every third order has a measurement."""
    measured = F.when(F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice"))
    return op.impact_summary(t.orders.withColumn("measured", measured), "o_custkey", F.col("o_orderstatus") != "P", "measured")


@query("""WITH r AS (SELECT o_orderpriority, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
 c AS (SELECT *, CAST((i * 16) // n AS INTEGER) AS c FROM r), b AS (SELECT *, (c & 1) * 8 + ((c >> 1) & 1) * 4 + ((c >> 2) & 1) * 2 + ((c >> 3) & 1) AS rev FROM c)
SELECT o_orderpriority, o_orderdate, o_orderkey, n AS runs, row_number() OVER (PARTITION BY o_orderpriority ORDER BY rev, i) AS turn FROM b""")
def ci_sampling_order(t):
    """The order in which workflows' runs are sampled."""
    return op.sampling_order(t.orders, "o_orderpriority", ["o_orderdate", "o_orderkey"], 4)
