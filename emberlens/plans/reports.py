"""Reports of scans: orders as findings of 40 checks in five scans, suppliers as the taxonomy."""

from pyspark.sql import functions as F

from ..operators import reports as op
from .registry import query

SQL_REPORT = """f AS (SELECT o_custkey % 5 AS scan, 'C' || o_orderkey % 40 AS check_id, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderpriority < '2' THEN 'high' WHEN o_orderpriority < '4' THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN o_custkey % 9 > 0 THEN 'f' || o_custkey % 20 END AS file, o_orderkey % 100 AS line FROM orders WHERE o_orderkey % 40 <> 5),
 c AS (SELECT DISTINCT o_custkey % 5 AS scan, o_orderkey % 40 AS k FROM orders),
 e AS (SELECT scan, 'C' || k AS check_id, 'o' || k % 4 AS owner, x.s_name AS pattern, 'layer' || x.s_nationkey % 6 AS layer, CASE WHEN k % 11 = 0 THEN 'error' WHEN k % 7 = 0 THEN 'unavailable' WHEN k % 13 = 0 THEN 'not_applicable' WHEN (k + scan) % 17 = 3 THEN 'error' WHEN scan % 2 = 0 THEN 'completed' ELSE 'partial' END AS status, k % 11 > 0 AND k % 7 > 0 AND k % 13 > 0 AND (k + scan) % 17 <> 3 AS own,
  CASE WHEN k % 11 = 0 THEN 'broke' WHEN k % 7 = 0 THEN 'no access' WHEN k % 13 = 0 THEN 'nothing to check' WHEN (k + scan) % 17 = 3 THEN 'invalid detector output rejected: bad' END AS reason FROM c LEFT JOIN supplier x ON x.s_suppkey = k AND k % 10 <> 9),
 l AS (SELECT o_custkey % 5 AS scan, 'C' || o_orderkey % 40 AS check_id, o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'note ' || o_orderkey % 2 ELSE NULL END AS note, 'd/' || o_custkey % 30 AS path, CASE o_orderstatus WHEN 'P' THEN 'too large' ELSE 'cannot parse <file> in state ' || o_orderstatus END AS kind FROM orders WHERE o_orderkey % 16 < 3 AND o_orderkey % 5 = 0),
 g AS (SELECT scan, check_id, kind, count(*) AS c, min(n) AS n, arg_min(path, n) AS path FROM l WHERE note IS NULL GROUP BY ALL),
 t AS (SELECT scan, check_id, 0 AS general, n, CASE c WHEN 1 THEN path || ': ' || replace(kind, '<file>', path) ELSE c || ' files: ' || kind || ' (e.g. ' || path || ')' END AS line FROM g UNION ALL SELECT scan, check_id, 1, n, note FROM l WHERE note IS NOT NULL),
 s AS (SELECT scan, check_id, string_agg(line, '|' ORDER BY general, n) FILTER (at_ <= 12) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY scan, check_id ORDER BY general, n) AS at_ FROM t) GROUP BY ALL),
 u AS (SELECT scan, check_id, count(*) AS total FROM l GROUP BY ALL), r AS (SELECT f.*, e.owner, e.layer, e.pattern FROM f JOIN e USING (scan, check_id) WHERE own)"""


def _report(t):
    o = t.orders.withColumns({"scan": F.col("o_custkey") % 5, "k": F.col("o_orderkey") % 40}).withColumn("check_id", F.concat(F.lit("C"), F.col("k")))
    level = F.when(F.col("o_orderpriority") < "2", "high").when(F.col("o_orderpriority") < "4", "medium").otherwise("low")
    findings = o.where("k != 5").select("scan", "check_id", F.col("o_orderkey").cast("string").alias("id"), level.alias("confidence"), F.when(F.col("o_custkey") % 9 > 0, F.concat(F.lit("f"), F.col("o_custkey") % 20)).alias("file"), (F.col("o_orderkey") % 100).alias("line"))
    k = F.col("k")
    broken, missing, void = k % 11 == 0, (k % 7 == 0) & (k % 11 != 0), (k % 13 == 0) & (k % 7 != 0) & (k % 11 != 0)
    rows = o.select("scan", "check_id", "k").distinct()
    runs = rows.select("scan", "check_id", F.concat(F.lit("o"), k % 4).alias("owner"), F.when(broken, "broke").alias("error"), F.when(missing, "no access").alias("unavailable"), F.when(void, "nothing to check").alias("not_applicable"), F.when(~(broken | missing | void), F.when(F.col("scan") % 2 == 0, "completed").otherwise("partial")).alias("result"))
    rejected = rows.where("(k + scan) % 17 = 3").select("scan", "check_id", F.lit("bad").alias("problem"))
    taxonomy = t.supplier.where("s_suppkey < 40 AND s_suppkey % 10 != 9").select(F.concat(F.lit("C"), F.col("s_suppkey")).alias("check_id"), F.col("s_name").alias("pattern"), F.concat(F.lit("layer"), F.col("s_nationkey") % 6).alias("layer"))
    path = F.concat(F.lit("d/"), F.col("o_custkey") % 30)
    reason = F.when(F.col("o_orderstatus") == "P", "too large").otherwise(F.concat(F.lit("cannot parse "), path, F.lit(" in state "), F.col("o_orderstatus")))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("note "), F.col("o_orderkey") % 2)).otherwise(F.concat(F.lit("file:"), path, F.lit(": "), reason))
    limitations = o.where("o_orderkey % 16 < 3 AND o_orderkey % 5 = 0").select("scan", "check_id", F.col("o_orderkey").alias("n"), text.alias("text"))
    entries = op.check_entries(runs, taxonomy, findings, limitations, rejected)
    return entries, op.report_findings(findings, entries)


@query(f"""WITH {SQL_REPORT} SELECT scan, check_id, owner, pattern, layer, status, CASE WHEN own THEN 'detector' ELSE 'scanner' END AS status_source, reason, CASE WHEN own THEN (SELECT count(*) FROM f WHERE f.scan = e.scan AND f.check_id = e.check_id) ELSE 0 END AS finding_count,
 CASE WHEN own THEN coalesce(lines, '') ELSE '' END AS limitations, CASE WHEN own THEN coalesce(total, 0) ELSE 0 END AS limitations_total, CAST(row_number() OVER (PARTITION BY scan ORDER BY owner, check_id) AS INT) AS place FROM e LEFT JOIN s USING (scan, check_id) LEFT JOIN u USING (scan, check_id)""")
def report_checks(t):
    """Checks of each scan with taxonomy, grade, counts and limitations, by owner and check."""
    return _report(t)[0].withColumn("limitations", F.array_join("limitations", "|"))


@query(f"""WITH {SQL_REPORT} SELECT scan, check_id, id, confidence, file, line, owner, layer, pattern, CAST(row_number() OVER (PARTITION BY scan ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, check_id, coalesce(file, ''), line, id) AS INT) AS place FROM r""")
def report_findings(t):
    """Findings of each scan in the report's order."""
    return _report(t)[1]


@query(f"""WITH {SQL_REPORT}, p AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, check_id, coalesce(file, ''), line, id) AS place FROM r),
 y AS (SELECT scan, string_agg(coalesce(layer, '-') || ':' || n, ',' ORDER BY n DESC, first) AS layers FROM (SELECT scan, layer, count(*) AS n, min(place) AS first FROM p GROUP BY ALL) GROUP BY scan), w AS (SELECT scan, string_agg(owner || ':' || n, ',' ORDER BY owner) AS owners FROM (SELECT scan, owner, count(*) AS n FROM p GROUP BY ALL) GROUP BY scan),
 x AS (SELECT scan, count(*) AS checks_total, 'completed:' || count(*) FILTER (status = 'completed') || ',partial:' || count(*) FILTER (status = 'partial') || ',unavailable:' || count(*) FILTER (status = 'unavailable') || ',error:' || count(*) FILTER (status = 'error') || ',not_applicable:' || count(*) FILTER (status = 'not_applicable') AS checks_by_status FROM e GROUP BY scan),
 z AS (SELECT scan, count(*) AS findings_total, 'high:' || count(*) FILTER (confidence = 'high') || ',medium:' || count(*) FILTER (confidence = 'medium') || ',low:' || count(*) FILTER (confidence = 'low') AS findings_by_confidence FROM p GROUP BY scan)
SELECT scan, checks_total, checks_by_status, findings_total, findings_by_confidence, layers AS findings_by_layer, owners AS findings_by_owner FROM x JOIN z USING (scan) JOIN y USING (scan) JOIN w USING (scan)""")
def report_summaries(t):
    """The summary of each scan."""
    out = op.summary(*_report(t))
    pairs = lambda c, values: F.array_join(F.array(*(F.concat(F.lit(f"{v}:"), F.col(c)[v]) for v in values)), ",")
    listed = lambda c, k: F.array_join(F.transform(c, lambda x: F.concat(F.coalesce(x[k], F.lit("-")), F.lit(":"), x["n"])), ",")
    return out.withColumns({"checks_by_status": pairs("checks_by_status", op.STATUSES), "findings_by_confidence": pairs("findings_by_confidence", op.CONFIDENCES), "findings_by_layer": listed("findings_by_layer", "layer"), "findings_by_owner": listed("findings_by_owner", "owner")})
