"""Telemetry rules on suppliers, users, event types and customers."""

from pyspark.sql import functions as F

from ..operators import telemetry as op
from .registry import query


@query("""
WITH a AS (SELECT l_suppkey, count(*) AS sample_count, round(avg(least(1.0, greatest(0.0, l_quantity / 500.0))), 4) AS average_utilization,
  round(max(least(1.0, greatest(0.0, l_quantity / 500.0))), 4) AS peak_utilization, round((epoch(max(l_shipdate)) - epoch(min(l_shipdate))) / 86400.0, 2) AS window_days
  FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_suppkey)
SELECT *, CASE WHEN NOT (window_days >= 14 AND sample_count >= 100) THEN 'omitted' WHEN average_utilization < 0.1 AND peak_utilization < 0.5 THEN 'detected' ELSE 'clean' END AS status,
  CASE WHEN window_days >= 14 AND sample_count >= 100 AND average_utilization < 0.1 AND peak_utilization < 0.5 THEN CASE WHEN peak_utilization <= 0.25 THEN 'high' ELSE 'medium' END END AS confidence FROM a
""")
def inf01_utilisation(t):
    """INF-01 on suppliers: shipped quantity as a share of 500."""
    return op.over_provisioned(t.lineitem, "l_suppkey", "l_shipdate", F.col("l_quantity") / 500.0)


@query("""
WITH a AS (SELECT user_id, count(*) AS sample_count, round(avg(least(1.0, greatest(0.0, value / 100.0))), 4) AS mean_utilization,
  round(median(value / 100.0), 6) AS median_utilization, round(max(value / 100.0), 4) AS peak_utilization FROM events WHERE value IS NOT NULL GROUP BY user_id)
SELECT *, CASE WHEN sample_count < 5 THEN 'omitted' WHEN median_utilization < 0.1 AND peak_utilization >= 0.5 AND peak_utilization >= 4.0 * mean_utilization THEN 'detected' ELSE 'clean' END AS status FROM a
""")
def llm17_bursty(t):
    """LLM-17 on users: event value as a share of 100."""
    return op.bursty(t.events, "user_id", F.col("value") / 100.0, op.Bursts(min_samples=5))


@query("""
WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL),
 s AS (SELECT user_id, count(n) AS datapoints, sum(n) AS activity, date_diff('day', min(day), max(day)) + 1 AS observed_days FROM a GROUP BY user_id)
SELECT i.user_id, CAST(coalesce(datapoints, 0) AS BIGINT) AS datapoints, CAST(coalesce(activity, 0) AS BIGINT) AS activity, CAST(coalesce(observed_days, 0) AS BIGINT) AS observed_days,
 CASE WHEN NOT (coalesce(datapoints, 0) > 0 AND coalesce(observed_days, 0) >= 14) THEN 'omitted' WHEN coalesce(activity, 0) <= 2 THEN 'detected' ELSE 'clean' END AS status
FROM (SELECT DISTINCT user_id FROM events) i LEFT JOIN s ON i.user_id = s.user_id
""")
def inf04_no_use(t):
    """INF-04 on users: purchases a day."""
    days = t.events.where("event_type = 'purchase'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return op.no_use(days, t.events, "user_id", "day", "n", 14, 2)


@query("""
WITH l AS (SELECT event_type, 'user' AS dimension, CAST(user_id AS VARCHAR) AS value FROM events UNION ALL SELECT event_type, 'k', json_extract_string(props, '$.k') FROM events),
 a AS (SELECT event_type, dimension, count(DISTINCT value) AS distinct_values, count(*) AS series, bool_and(regexp_matches(value, '^[0-9]{2,}$|^[0-9a-fA-F-]{16,}$')) AS id_like FROM l WHERE value IS NOT NULL GROUP BY ALL)
SELECT *, CASE WHEN distinct_values > 100 OR (id_like AND distinct_values > 10) THEN 'detected' ELSE 'clean' END AS status,
 CASE WHEN distinct_values > 100 OR (id_like AND distinct_values > 10) THEN CASE WHEN id_like THEN 'high' ELSE 'medium' END END AS confidence FROM a
""")
def obs06_cardinality(t):
    """OBS-06 on event types: users and the property k as dimensions."""
    return op.cardinality(t.events, "event_type", {"user": F.col("user_id"), "k": F.get_json_object("props", "$.k")}, 100, 10)


@query("""
WITH g AS (SELECT c_custkey, c_mktsegment, round(sum(o_totalprice), 2) AS stored, date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '1998-12-31') AS retention FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
SELECT c_custkey, c_mktsegment, stored, CAST(retention AS INTEGER) AS retention, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'exempt' WHEN stored < 100000 THEN 'small' WHEN retention IS NULL THEN 'never expires' WHEN retention > 365 THEN 'too long' ELSE 'fine' END AS reason,
 CASE WHEN c_mktsegment = 'MACHINERY' OR stored < 100000 THEN 'clean' WHEN retention IS NULL OR retention > 365 THEN 'detected' ELSE 'clean' END AS status FROM g
""")
def obs07_hot_retention(t):
    """OBS-07 on customers: money as bytes, age of the oldest order as retention, one segment exempt."""
    groups = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey", "c_mktsegment")
    groups = groups.agg(F.round(F.sum("o_totalprice"), 2).alias("stored"), F.datediff(F.lit("1998-12-31").cast("date"), F.to_date(F.min("o_orderdate"))).alias("retention"))
    return op.hot_retention(groups, "retention", "stored", 365, 100000, F.col("c_mktsegment") == "MACHINERY")


@query("""
WITH l AS (SELECT event_type, event_id, unnest(['User-Id', 'k', 'path', 'window']) AS label, unnest([CAST(user_id AS VARCHAR), json_extract_string(props, '$.k'), '/orders/' || (100 + user_id), CAST(100000000 + event_id // 3000 AS VARCHAR)]) AS value FROM events),
 v AS (SELECT event_type, label, value, min(event_id) AS n FROM l GROUP BY ALL), c AS (SELECT event_type, label, count(*) AS distinct_values FROM v GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY event_type, label ORDER BY n, value) AS r FROM v),
 s AS (SELECT event_type, label, string_agg(value, ',' ORDER BY r) AS samples FROM f WHERE r <= 5 GROUP BY ALL), e AS (SELECT event_type, count(*) AS series FROM events GROUP BY ALL),
 j AS (SELECT event_type, label, series, distinct_values, label = 'User-Id' AS by_name, label IN ('path', 'window') AS by_shape, samples FROM c JOIN s USING (event_type, label) JOIN e USING (event_type)),
 h AS (SELECT *, distinct_values > 120 OR ((by_name OR by_shape) AND distinct_values > 3) AS hit FROM j)
SELECT *  EXCLUDE (hit), CASE WHEN event_type = 'view' THEN 'omitted' WHEN hit THEN 'detected' ELSE 'clean' END AS status, CASE WHEN event_type <> 'view' AND hit THEN CASE WHEN distinct_values > 120 AND (by_name OR by_shape) THEN 'high' WHEN distinct_values > 120 OR by_shape THEN 'medium' ELSE 'low' END END AS confidence FROM h
""")
def obs06_labels(t):
    """OBS-06 on event types as metrics: users, the property k, paths of users and epochs as labels; one listing was cut."""
    labels = F.create_map(F.lit("User-Id"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("path"), F.concat(F.lit("/orders/"), 100 + F.col("user_id")), F.lit("window"), (100000000 + F.floor(F.col("event_id") / 3000)).cast("string"))
    listing = t.events.select("event_type", "event_id", labels.alias("labels"))
    complete = t.events.select("event_type").distinct().withColumn("complete", F.col("event_type") != "view")
    out = op.label_cardinality(listing, "event_type", "event_id", "labels", complete, 120, 3)
    return out.withColumn("samples", F.array_join("samples", ","))
