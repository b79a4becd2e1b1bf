"""Run histories on orders: customers in repositories, their orders as runs of workflows."""

from pyspark.sql import functions as F

from ..operators import ci, ci_history as op
from .registry import query

SQL_RUNS = """r AS (SELECT o_custkey % 9 AS repo, 'w' || o_custkey % 7 AS path, o_orderkey AS id, o_orderdate AS created, CASE WHEN o_orderkey % 19 = 0 THEN 'queued' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 'action_required' WHEN o_orderstatus = 'F' THEN 'failure' ELSE 'success' END AS conclusion, o_orderpriority AS event, 1 + o_orderkey % 3 AS attempt FROM orders)"""


def _runs(t):
    k = F.col("o_orderkey")
    ended = F.when(k % 19 == 0, None).when(k % 23 == 0, "action_required").when(F.col("o_orderstatus") == "F", "failure").otherwise("success")
    return t.orders.select((F.col("o_custkey") % 9).alias("repo"), F.concat(F.lit("w"), F.col("o_custkey") % 7).alias("path"), k.alias("id"), F.col("o_orderdate").alias("created"), F.when(k % 19 == 0, "queued").otherwise("completed").alias("status"), ended.alias("conclusion"), F.col("o_orderpriority").alias("event"), (1 + k % 3).alias("attempt"))


@query(f"""WITH {SQL_RUNS}, f AS (SELECT repo, count(*) AS n, min(created) AS oldest FROM r GROUP BY ALL)
SELECT repo, id, CASE WHEN repo % 2 = 1 THEN oldest ELSE TIMESTAMP '1990-01-01' END AS window_start, repo % 2 = 1 AS start_exclusive FROM r JOIN f USING (repo) WHERE repo % 2 = 0 OR created > oldest""")
def ci_window(t):
    """Runs that a listing certifies: those of every other repository were cut."""
    runs = _runs(t)
    totals = runs.groupBy("repo").agg(F.count("*").alias("n")).select("repo", F.when(F.col("repo") % 2 == 1, F.col("n") + 5).when(F.col("repo") > 4, F.col("n") - 1).alias("total"), F.lit("1990-01-01").cast("timestamp_ntz").alias("since"))
    return op.certified(runs, totals, "repo", "created").select("repo", "id", "window_start", "start_exclusive")


@query(f"""WITH {SQL_RUNS}, x AS (SELECT *, count(*) OVER (PARTITION BY repo, path) AS n, row_number() OVER (PARTITION BY repo, path ORDER BY created DESC, id) - 1 AS i FROM r WHERE status = 'completed' AND conclusion IS DISTINCT FROM 'action_required'),
 s AS (SELECT DISTINCT n FROM x), p AS (SELECT n, 0 AS stage, 0 AS j, 0 AS k, 0 AS i FROM s UNION ALL SELECT n, 1, 0, 0, n - 1 FROM s UNION ALL SELECT n, 2, j, k, k * (n - 1) // (1 << j) FROM (SELECT n, j, unnest(range(1, 1 << j, 2)) AS k FROM (SELECT n, unnest(range(1, CAST(ceil(log2(2 * n + 1)) AS INT) + 1)) AS j FROM s))
  UNION ALL SELECT n, 3, 0, i, i FROM (SELECT n, unnest(range(0, n)) AS i FROM s)), m AS (SELECT n, i, min([stage, j, k]) AS first FROM p GROUP BY ALL),
 y AS (SELECT x.*, row_number() OVER (PARTITION BY repo, path ORDER BY first) AS turn FROM x JOIN m USING (n, i))
SELECT repo, path, id, CAST(turn AS INT) AS turn, CAST(row_number() OVER (PARTITION BY repo ORDER BY turn, n DESC, path) AS INT) AS place FROM y""")
def ci_sampling_turns(t):
    """Runs in the order in which they are sampled."""
    return op.sampling_turns(_runs(t), "repo", "path", [F.desc("created"), F.col("id")], "status", "conclusion").select("repo", "path", "id", "turn", "place")


@query(f"""WITH {SQL_RUNS}, c AS (SELECT repo, path, string_agg(v || ':' || n, ',' ORDER BY n DESC, v) AS by_conclusion FROM (SELECT repo, path, coalesce(conclusion, status) AS v, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL), e AS (SELECT repo, path, string_agg(event || ':' || n, ',' ORDER BY n DESC, event) AS by_event FROM (SELECT repo, path, event, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL),
 g AS (SELECT repo, path, count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'completed' AND conclusion <> 'action_required') AS executed, count(*) FILTER (conclusion = 'action_required') AS awaiting, count(*) FILTER (attempt > 1) AS retried FROM r GROUP BY ALL) SELECT * FROM g JOIN c USING (repo, path) JOIN e USING (repo, path)""")
def ci_workflows(t):
    """Roll-up of every workflow with its conclusions and events."""
    out = op.workflow_rollup(_runs(t), "repo", "path", "status", "conclusion", "event", "attempt")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["value"], F.lit(":"), x["n"])), ",")
    return out.withColumns({"by_conclusion": text("by_conclusion"), "by_event": text("by_event")})


@query("""WITH a AS (SELECT l_partkey AS workflow, l_suppkey % 5 AS sha, l_orderkey AS run, CASE WHEN l_returnflag = 'R' THEN 'failure' ELSE 'success' END AS conclusion, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS attempt, l_partkey FROM lineitem),
 p AS (SELECT workflow, sha, lag(conclusion) OVER (PARTITION BY run ORDER BY attempt) = 'failure' AS again FROM a), s AS (SELECT workflow, sha, count(*) FILTER (again) AS n FROM p GROUP BY ALL), w AS (SELECT workflow, max(n) AS max_rechecks, CAST(sum(n) AS BIGINT) AS rechecks FROM s GROUP BY ALL), c AS (SELECT workflow, count(DISTINCT run) AS runs FROM a GROUP BY ALL)
SELECT workflow, max_rechecks, rechecks, CASE WHEN runs < 30 THEN 'omitted' WHEN max_rechecks >= 5 THEN 'detected' ELSE 'clean' END AS status, CASE WHEN runs < 30 THEN NULL WHEN max_rechecks >= 10 THEN 'high' WHEN max_rechecks >= 5 THEN 'medium' END AS confidence, runs FROM w JOIN c USING (workflow)""")
def ci01_gated(t):
    """CI-01 with the history gate: parts as workflows, an order's line items as attempts; 30 runs at least."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = t.lineitem.select(F.col("l_partkey").alias("workflow"), (F.col("l_suppkey") % 5).alias("sha"), F.col("l_orderkey").alias("run"), F.when(F.col("l_returnflag") == "R", "failure").otherwise("success").alias("conclusion"), n.alias("attempt"))
    return op.gated(ci.rechecks(rows, "workflow", "sha", "run", ["attempt"], "conclusion", 5), rows, "workflow", "run", 30)
