"""Report operators on findings derived from events: the first half of the ids as one scan, the second as the next."""

from pyspark.sql import functions as F

from ..functions.contract import fingerprint
from ..operators import report as op
from .registry import query

SQL_FOUND = """f AS (SELECT event_type AS scope, user_id, value, event_id, sha256('["events","JOB-01","' || event_type || '","user ' || user_id || '"]') AS fingerprint FROM events),
 b AS (SELECT DISTINCT fingerprint, scope FROM f WHERE event_id % 2 = 0 AND value > 20), a AS (SELECT DISTINCT fingerprint, scope FROM f WHERE event_id % 2 = 1 AND value > 20)"""


def _found(t):
    name = fingerprint(F.lit("events"), F.lit("JOB-01"), F.col("event_type"), F.concat(F.lit("user "), F.col("user_id")))
    return t.events.select(F.col("event_type").alias("scope"), "user_id", "value", "event_id", name.alias("fingerprint"))


@query(f"WITH {SQL_FOUND} SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, coalesce(a.scope, b.scope) AS scope, CASE WHEN a.scope IS NOT NULL AND b.scope IS NOT NULL THEN 'persisting' WHEN coalesce(a.scope, b.scope) = 'error' THEN 'unknown' WHEN a.scope IS NOT NULL THEN 'new' ELSE 'gone' END AS state FROM b FULL JOIN a ON a.fingerprint = b.fingerprint")
def finding_compare(t):
    """Findings of two scans; errors were not evaluated alike."""
    rows = _found(t).where("value > 20")
    parts = [rows.where(F.col("event_id") % 2 == k).select("fingerprint", "scope").distinct() for k in (0, 1)]
    return op.compare(*parts, "fingerprint", "scope", t.events.select(F.col("event_type").alias("scope")).distinct().where("scope <> 'error'"))


@query(f"WITH {SQL_FOUND} SELECT fingerprint, scope, event_id FROM f WHERE value > 50 AND EXISTS (SELECT 1 FROM events e WHERE e.user_id = f.user_id AND e.event_type = 'purchase')")
def hub_committed_findings(t):
    """Findings of users with a purchase, which stands for the result marker."""
    marks = t.events.where("event_type = 'purchase'").select("user_id")
    return op.committed(_found(t).where("value > 50"), marks, "user_id").select("fingerprint", "scope", "event_id")


CONFIDENCES = ["high", "medium", "low"]


@query("WITH c AS (SELECT CASE WHEN value > 50 THEN 'high' WHEN value > 5 THEN 'medium' END AS confidence FROM events) SELECT v.confidence, coalesce(n, 0) AS n FROM (VALUES ('high'), ('medium'), ('low')) v(confidence) LEFT JOIN (SELECT confidence, count(*) AS n FROM c GROUP BY ALL) g ON g.confidence = v.confidence")
def report_totals(t):
    """Counts by confidence, zero rows included."""
    return op.totals(t.events.select(F.when(F.col("value") > 50, "high").when(F.col("value") > 5, "medium").alias("confidence")), "confidence", CONFIDENCES)


@query("SELECT p_type, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY p_type ORDER BY n DESC, first_seen, p_type LIMIT 15")
def top_extensions(t):
    """The 15 most common part types, ties as first seen."""
    return op.top(t.part, "p_type", "p_partkey", 15)


@query("SELECT lang AS reason, count(*) AS n, arg_min(source, doc_id) AS example FROM documents GROUP BY lang ORDER BY n DESC, reason LIMIT 12")
def report_limitations(t):
    """Documents as limitations by language, the first source as example."""
    return op.summarized_limitations(t.documents.withColumnRenamed("lang", "reason"), "reason", "source", "doc_id")


@query("SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, CASE WHEN n > 1 THEN l_returnflag || '#' || n ELSE l_returnflag END AS identity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS n FROM lineitem)")
def identity_ordinals(t):
    """Identities of line items by return flag within an order."""
    return op.ordinals(t.lineitem.select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey"), ["l_orderkey"], "l_returnflag", ["l_linenumber", "l_partkey"])


@query("WITH s AS (SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, source FROM documents WHERE lang = 'fr') SELECT 'duplicate source' AS rule, CAST(doc_id AS VARCHAR) AS key FROM s GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT 'source out of scope', CAST(doc_id AS VARCHAR) FROM s WHERE source = 'src1'")
def contract_violations(t):
    """Contract rules on documents as sources: French ones twice, one scope missing."""
    docs = t.documents.select(F.col("doc_id").alias("source_id"), F.col("source").alias("scope_id"), "lang")
    sources = docs.select("source_id", "scope_id").unionByName(docs.where("lang = 'fr'").select("source_id", "scope_id"))
    scopes = docs.select("scope_id").distinct().where("scope_id <> 'src1'").withColumn("evaluated", F.lit(True))
    name = fingerprint(F.lit("documents"), F.lit("X"), F.col("scope_id"), F.col("source_id").cast("string"))
    none = docs.where(F.lit(False)).select("source_id", "scope_id").withColumn("fingerprint", name)
    return op.violations(sources, scopes, none, name)
