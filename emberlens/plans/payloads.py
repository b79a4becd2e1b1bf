"""Contract rules on orders as payloads: line items as scopes, findings and measurements."""

from pyspark.sql import functions as F

from ..functions.contract import fingerprint
from ..operators import payloads as op
from .registry import query

# an order is a result: its line items' suppliers are its scope, those of larger items were evaluated, returned ones were found
SQL_RESULTS = """r AS (SELECT o_orderkey AS payload, 'C' || o_orderkey % 50 AS check_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'partial' ELSE 'error' END AS status, o_orderpriority FROM orders),
 l AS (SELECT l_orderkey AS payload, 's' || l_suppkey AS scope_id, l_quantity, l_returnflag, l_discount, l_tax, l_partkey, l_linenumber, CAST(l_shipdate AS DATE) AS day FROM lineitem),
 asked AS (SELECT DISTINCT payload, scope_id FROM l WHERE l_tax < 0.08), done AS (SELECT DISTINCT payload, scope_id FROM l WHERE l_quantity >= 20 OR payload % 3 = 0),
 f AS (SELECT payload, scope_id, 'p' || l_partkey % 3 AS identity, sha256('["r","C' || payload % 50 || '","' || scope_id || '","p' || l_partkey % 3 || '"]') AS right_one FROM l WHERE l_returnflag = 'R'),
 fp AS (SELECT *, CASE WHEN payload % 40 = 7 THEN 'changed' ELSE right_one END AS fingerprint FROM f),
 m AS (SELECT payload, CASE WHEN l_partkey % 2 = 0 THEN 'energy' ELSE 'tokens' END AS metric, CASE WHEN l_partkey % 2 = 0 OR l_linenumber = 7 THEN 'kWh' ELSE 'count' END AS unit, 'a' || l_linenumber % 2 AS allocation_key, day, l_linenumber % 5 AS long, l_discount > 0.09 AS bare FROM l WHERE l_returnflag = 'N'),
 n AS (SELECT r.payload, status, (SELECT count(*) FROM asked a WHERE a.payload = r.payload) AS n_asked, (SELECT count(*) FROM done d WHERE d.payload = r.payload) AS n_done, (SELECT count(*) FROM done d JOIN asked a USING (payload, scope_id) WHERE d.payload = r.payload) AS n_both,
  (SELECT count(*) FROM fp WHERE fp.payload = r.payload) AS n_found, (SELECT count(*) FROM m WHERE m.payload = r.payload) AS n_measured, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END AS n_limits FROM r)"""


@query(f"""WITH {SQL_RESULTS}, v AS (SELECT payload, 'unknown check' AS rule, check_id AS key FROM r WHERE check_id = 'C13'
 UNION ALL SELECT payload, 'evaluated out of scope', scope_id FROM done d WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.payload = d.payload AND a.scope_id = d.scope_id)
 UNION ALL SELECT payload, 'completed must evaluate all', status FROM n WHERE status = 'completed' AND NOT (n_both = n_asked AND n_done = n_asked)
 UNION ALL SELECT payload, 'partial must evaluate some', status FROM n WHERE status = 'partial' AND NOT (n_done > 0 AND n_both = n_done AND n_done < n_asked)
 UNION ALL SELECT payload, 'unevaluated must be empty', status FROM n WHERE status = 'error' AND n_done + n_found + n_measured > 0
 UNION ALL SELECT payload, 'incomplete must explain', status FROM n WHERE status <> 'completed' AND n_limits = 0
 UNION ALL SELECT payload, 'finding out of evaluated scope', fingerprint FROM fp WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.payload = fp.payload AND d.scope_id = fp.scope_id)
 UNION ALL SELECT payload, 'wrong fingerprint', fingerprint FROM fp WHERE fingerprint <> right_one
 UNION ALL SELECT payload, 'duplicate fingerprint', fingerprint FROM fp GROUP BY payload, fingerprint HAVING count(*) > 1
 UNION ALL SELECT payload, 'metric and unit', metric || ':' || allocation_key FROM m WHERE unit <> CASE metric WHEN 'energy' THEN 'kWh' ELSE 'count' END
 UNION ALL SELECT payload, 'timestamp without a zone', metric || ':' || allocation_key FROM m WHERE bare
 UNION ALL SELECT payload, 'start before end', metric || ':' || allocation_key FROM m WHERE NOT bare AND long = 0
 UNION ALL SELECT payload, 'duplicate measurement', metric || ':' || allocation_key FROM m WHERE NOT bare GROUP BY payload, metric, allocation_key, day, long HAVING count(*) > 1)
SELECT payload, rule, key FROM v""")
def result_violations(t):
    """What is wrong with orders as results, by every rule of the contract."""
    results = t.orders.select(F.col("o_orderkey").alias("payload"), F.concat(F.lit("C"), F.col("o_orderkey") % 50).alias("check_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "partial").otherwise("error").alias("status"), "o_orderpriority")
    items = t.lineitem.withColumns({"payload": F.col("l_orderkey"), "scope_id": F.concat(F.lit("s"), F.col("l_suppkey")), "check_id": F.concat(F.lit("C"), F.col("l_orderkey") % 50), "day": F.to_date("l_shipdate")})
    scopes, evaluated = items.where("l_tax < 0.08"), items.where("l_quantity >= 20 OR payload % 3 = 0")
    own = fingerprint(F.lit("r"), F.col("check_id"), F.col("scope_id"), F.col("identity"))
    findings = items.where("l_returnflag = 'R'").withColumn("identity", F.concat(F.lit("p"), F.col("l_partkey") % 3)).withColumn("fingerprint", F.when(F.col("payload") % 40 == 7, "changed").otherwise(own))
    even, zone = F.col("l_partkey") % 2 == 0, F.when(F.col("l_discount") > 0.09, "").otherwise("Z")
    at = lambda day: F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00"), zone)
    measurements = items.where("l_returnflag = 'N'").select(
        "payload", F.when(even, "energy").otherwise("tokens").alias("metric"), F.when(even | (F.col("l_linenumber") == 7), "kWh").otherwise("count").alias("unit"), F.concat(F.lit("a"), F.col("l_linenumber") % 2).alias("allocation_key"),
        at(F.col("day")).alias("start"), at(F.date_add("day", F.col("l_linenumber") % 5)).alias("end"),
    )
    limits = results.where("o_orderpriority != '1-URGENT'")
    return op.result_violations(results, scopes, evaluated, findings, measurements, limits, results.where("check_id != 'C13'"), own)
