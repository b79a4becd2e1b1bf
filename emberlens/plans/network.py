"""Network rules on events, line items and pages."""

from pyspark.sql import functions as F

from ..operators import network as op
from .registry import query


@query("SELECT user_id, event_type, count(*) AS calls, max(value) AS largest, round(sum(value), 4) AS setup, CASE WHEN count(*) < 3 THEN 'omitted' WHEN max(value) <= 50 AND sum(value) > 0 THEN 'detected' ELSE 'clean' END AS status FROM events GROUP BY ALL")
def net01_chatty(t):
    """NET-01 on events: user and type as destination and operation."""
    return op.chatty(t.events, ["user_id", "event_type"], "value", "value", 3, 50)


@query("""WITH a AS (SELECT l_suppkey, count(*) AS fields, round(sum(l_extendedprice), 2) AS bytes, round(sum(CASE WHEN l_discount < 0.05 THEN l_extendedprice ELSE 0.0 END), 2) AS unused_bytes FROM lineitem GROUP BY ALL)
SELECT *, CASE WHEN NOT (fields >= 20 AND bytes > 0) THEN 'omitted' WHEN unused_bytes >= 0.4 * bytes THEN 'detected' ELSE 'clean' END AS status FROM a""")
def net02_overfetch(t):
    """NET-02 on suppliers: price as bytes, a discount as use."""
    return op.overfetch(t.lineitem, "l_suppkey", "l_extendedprice", F.col("l_discount") >= 0.05, 0.4, 20)


@query("""WITH h AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, md5(html) AS body FROM pages), a AS (SELECT host, count(*) AS requests, count(DISTINCT body) AS versions FROM h GROUP BY ALL)
SELECT *, requests - versions AS repeats, CASE WHEN requests < 2 THEN 'omitted' WHEN requests - versions > 0 THEN 'detected' ELSE 'clean' END AS status FROM a""")
def net03_cache(t):
    """NET-03 on pages: a host as route, equal pages as repeated responses."""
    return op.uncached(t.pages.select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.md5(F.col("html").cast("binary")).alias("body")), "host", "body", 2)


@query("""WITH g AS (SELECT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, event_type, count(*) AS attempts, count(*) FILTER (gap < 86400) AS rapid, min(gap) AS least_gap, CASE WHEN count(*) < 3 THEN 'omitted' WHEN count(*) FILTER (gap < 86400) >= 2 THEN 'detected' ELSE 'clean' END AS status FROM g GROUP BY ALL""")
def net05_retry(t):
    """NET-05 on events: events of a user and type as attempts, less than a day apart."""
    return op.retries(t.events, ["user_id", "event_type"], ["ts", "event_id"], F.unix_timestamp(F.col("ts").cast("timestamp")), 86400, 3)


@query("""WITH c AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type AS changed FROM events)
SELECT user_id, count(*) AS polls, count(*) FILTER (changed) AS changes, CASE WHEN count(*) < 5 THEN 'omitted' WHEN count(*) FILTER (changed) <= 0.5 * count(*) THEN 'detected' ELSE 'clean' END AS status FROM c GROUP BY ALL""")
def net06_polling(t):
    """NET-06 on users: events as polls, their type as the answer."""
    return op.polling(t.events, "user_id", ["ts", "event_id"], "event_type", 0.5, 5)


@query("SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes, CASE WHEN strlen(html) < 2048 THEN 'small' WHEN url LIKE 'https:%' THEN 'plain' ELSE 'not accepted' END AS reason, CASE WHEN strlen(html) >= 2048 AND url LIKE 'https:%' THEN 'detected' ELSE 'clean' END AS status FROM pages")
def net07_compression(t):
    """NET-07 on pages: all are HTML; https stands for a client that takes encodings."""
    return op.uncompressed(t.pages, "page_id", F.octet_length("html"), F.lit("text/html"), F.col("url").startswith("https:"), F.lit(False), 2048)


@query("SELECT user_id, event_type, props, count(*) AS requests, 'detected' AS status FROM events GROUP BY user_id, event_type, props HAVING count(*) > 1")
def net11_duplicates(t):
    """NET-11 on events: same user, type and properties."""
    return op.duplicates(t.events, ["user_id", "event_type", "props"])


SQL_SHIP = "s AS (SELECT *, CAST(l_shipdate AS DATE) AS ship_start, CAST(l_shipdate AS DATE) + 3 AS ship_end FROM lineitem)"


@query(f"""WITH {SQL_SHIP}, o AS (SELECT l_orderkey, ship_start < max(ship_end) OVER (PARTITION BY l_orderkey ORDER BY ship_start, ship_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM s)
SELECT l_orderkey, count(*) AS requests, count(*) FILTER (hit) AS "overlaps", CASE WHEN count(*) < 3 THEN 'omitted' WHEN count(*) FILTER (hit) = 0 THEN 'detected' ELSE 'clean' END AS status FROM o GROUP BY ALL""")
def net11_waterfall(t):
    """NET-11 on orders: shipments of three days that never overlap."""
    rows = t.lineitem.select("l_orderkey", F.to_date("l_shipdate").alias("ship_start")).withColumn("ship_end", F.date_add("ship_start", 3))
    return op.waterfall(rows, "l_orderkey", "ship_start", "ship_end", 3)


@query(f"""WITH {SQL_SHIP}, p AS (SELECT l_suppkey, ship_start AS moment, l_quantity AS change, 1 AS n FROM s UNION ALL SELECT l_suppkey, ship_end, -l_quantity, -1 FROM s),
 g AS (SELECT l_suppkey, moment, sum(change) AS change, sum(n) AS n FROM p GROUP BY ALL), r AS (SELECT l_suppkey, sum(change) OVER w AS amount, sum(n) OVER w AS n FROM g WINDOW w AS (PARTITION BY l_suppkey ORDER BY moment ROWS UNBOUNDED PRECEDING))
SELECT l_suppkey, round(max(amount), 2) AS peak_amount, CAST(max(n) AS BIGINT) AS peak_count FROM r GROUP BY ALL""")
def net09_sweep(t):
    """NET-09 on suppliers: quantity on its way, three days each."""
    rows = t.lineitem.select("l_suppkey", "l_quantity", F.to_date("l_shipdate").alias("ship_start")).withColumn("ship_end", F.date_add("ship_start", 3))
    return op.sweep(rows, "l_suppkey", "ship_start", "ship_end", "l_quantity")


@query("""WITH s AS (SELECT l_orderkey, l_linestatus = 'O' AND lead(l_linestatus) OVER w = 'F' AND lead(l_linestatus, 2) OVER w = 'O' AS hit, l_tax + lead(l_tax) OVER w + lead(l_tax, 2) OVER w AS cost FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, count(*) AS triples, round(sum(cost), 2) AS cost FROM s WHERE hit GROUP BY ALL""")
def net12_triples(t):
    """NET-12 on orders: open, finished, open line items in a row."""
    return op.triples(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_linestatus", "O", "F", "l_tax")


SQL_ATTEMPTS = """e AS (SELECT user_id, event_type, event_id, floor(epoch(ts))::BIGINT AS begin_s, floor(epoch(ts))::BIGINT + CAST(floor(value * CASE WHEN user_id % 31 = 0 THEN 9000 ELSE 1 END) AS BIGINT) AS end_s, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
 a AS (SELECT *, n + CASE WHEN user_id % 9 = 0 AND n > 2 THEN 1 ELSE 0 END AS attempt, CASE WHEN event_id % 60 = 0 THEN 200 ELSE 503 END AS status, event_id % 70 <> 0 AS client_retry, event_type = 'view' AND user_id % 4 = 0 AS poll, CASE WHEN event_id % 40 = 1 THEN 200000 END AS retry_after FROM e)"""


@query(f"""WITH {SQL_ATTEMPTS}, g AS (SELECT *, begin_s - lag(end_s) OVER w AS gap, begin_s - lag(end_s) OVER w < lag(retry_after) OVER w AS ignored, lag(end_s) OVER w IS NOT NULL AND NOT client_retry AS other, lead(attempt) OVER w IS NOT NULL AND status < 429 AS fine FROM a WINDOW w AS (PARTITION BY user_id, event_type ORDER BY attempt)),
 s AS (SELECT user_id, event_type, count(*) AS attempts, count(*) FILTER (ignored) AS ignored, min(gap) AS least, max(gap) AS widest, count(*) FILTER (other OR fine OR poll) AS exempt, count(DISTINCT attempt) AS kinds, min(attempt) AS first_one, max(attempt) AS last_one FROM g GROUP BY ALL),
 r AS (SELECT *, CASE WHEN kinds < attempts OR first_one <> 1 OR last_one <> attempts THEN 'missing or duplicate attempt' WHEN least < 0 THEN 'overlapping attempts' END AS refused FROM s),
 v AS (SELECT *, CASE WHEN refused IS NULL AND attempts >= 3 AND exempt = 0 THEN CASE WHEN ignored > 0 THEN 'Retry-After ignored' WHEN coalesce(widest < 600000, TRUE) AND user_id % 2 <> 0 AND user_id % 3 <> 0 THEN 'no delay' WHEN user_id % 5 > 0 AND attempts > user_id % 5 * 6 THEN 'over the cap' END END AS reason FROM r)
SELECT user_id, event_type, attempts, ignored, refused, reason, CASE WHEN refused IS NOT NULL THEN 'omitted' WHEN reason IS NOT NULL THEN 'detected' ELSE 'clean' END AS status FROM v""")
def net05_storms(t):
    """NET-05 on events: events of a user and type as attempts, users' policies, some sequences broken."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    at, user, event = F.unix_seconds(F.col("ts").cast("timestamp")), F.col("user_id"), F.col("event_id")
    attempts = t.events.select(
        "user_id", "event_type", (n + F.when((user % 9 == 0) & (n > 2), 1).otherwise(0)).alias("attempt"), at.alias("begin"), (at + F.floor(F.col("value") * F.when(user % 31 == 0, 9000).otherwise(1))).alias("end"), F.when(event % 60 == 0, 200).otherwise(503).alias("status"),
        (event % 70 != 0).alias("client_retry"), ((F.col("event_type") == "view") & (user % 4 == 0)).alias("poll"), F.when(event % 40 == 1, 200000).alias("retry_after"),
    )
    policies = t.events.select("user_id").distinct().select("user_id", (user % 2 == 0).alias("backoff"), (user % 3 == 0).alias("jitter"), (user % 5 * 6).alias("max_attempts"))
    return op.retry_storms(attempts, ["user_id", "event_type"], policies, "user_id", 3, 600000)


@query("""WITH c AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type AS changed, value FROM events), g AS (SELECT user_id, count(*) AS polls, count(*) FILTER (changed) AS changes, round(avg(value), 4) AS interval_s FROM c GROUP BY ALL),
 u AS (SELECT *, user_id % 3 <> 0 AND user_id % 7 <> 0 AND user_id % 11 <> 0 AND user_id % 5 <> 0 AND user_id % 40 <= 30 AS alternative FROM g)
SELECT user_id, polls, changes, interval_s AS "interval", alternative, CASE WHEN alternative AND polls >= 5 AND interval_s <= 60 AND changes <= 0.75 * polls THEN 'detected' ELSE 'clean' END AS status FROM u""")
def net06_alternatives(t):
    """NET-06 on users: events as polls, some users with an event as fresh."""
    user = F.col("user_id")
    targets = t.events.select("user_id").distinct().select("user_id", F.lit(30).alias("freshness"), (user % 40).alias("delivery"), (user % 5 == 0).alias("reconciliation"), (user % 3 != 0).alias("supported"), (user % 7 != 0).alias("reachable"), (user % 11 != 0).alias("recovery"))
    return op.event_alternatives(t.events, "user_id", ["ts", "event_id"], "event_type", F.col("value"), targets, 0.75, 5, 60)


@query("""WITH r AS (SELECT page_id, strlen(html) AS bytes, page_id % 11 = 0 AS exempt, [NULL, 'gzip', 'gzip;q=0', '*', 'identity', 'br;q=0.5, *;q=0', '*;q=0, Zstd ; q=1.0', 'gzip, gzip;q=0.1', 'br;q=x', ''][page_id % 10 + 1] AS accept, CASE WHEN page_id % 13 = 0 THEN 'GZIP' END AS encoding, CASE WHEN page_id % 17 = 0 THEN 1 ELSE 0 END AS more, ['text/html; charset=utf-8', 'application/ld+JSON', 'image/png', 'application/jsonx'][page_id % 4 + 1] AS type FROM pages),
 v AS (SELECT page_id, bytes, CASE WHEN exempt THEN 'exempt' WHEN bytes < 1024 THEN 'small' WHEN accept IN ('gzip, gzip;q=0.1', 'br;q=x') THEN 'malformed' WHEN accept IS NULL OR accept IN ('gzip;q=0', 'identity', '') THEN 'not accepted' WHEN encoding IS NOT NULL THEN 'encoded' WHEN more > 0 THEN 'sizes differ' WHEN type IN ('image/png', 'application/jsonx') THEN 'binary' ELSE 'plain' END AS reason FROM r)
SELECT page_id, bytes, reason, CASE reason WHEN 'plain' THEN 'detected' WHEN 'malformed' THEN 'omitted' WHEN 'sizes differ' THEN 'omitted' ELSE 'clean' END AS status FROM v""")
def net07_responses(t):
    """NET-07 on pages as responses: headers of several clients, encodings and types."""
    page, none = F.col("page_id"), F.lit(None).cast("string")
    pick = lambda values: F.element_at(F.array(*(F.lit(x).cast("string") for x in values)), (page % len(values) + 1).cast("int"))
    no, bytes_ = F.lit(False), F.octet_length("html").cast("long")
    rows = t.pages.select(
        "page_id", F.when(page % 22 == 0, "HEAD").otherwise("GET").alias("method"), F.when(page % 33 == 0, 206).otherwise(200).alias("status"), (page % 11 != 0).alias("body"), no.alias("ranged"), no.alias("streaming"), no.alias("reflects"), no.alias("busy"), bytes_.alias("encoded"),
        (bytes_ + F.when(page % 17 == 0, 1).otherwise(0)).alias("decoded"), pick([None, "gzip", "gzip;q=0", "*", "identity", "br;q=0.5, *;q=0", "*;q=0, Zstd ; q=1.0", "gzip, gzip;q=0.1", "br;q=x", ""]).alias("accept"), F.when(page % 13 == 0, "GZIP").otherwise(none).alias("encoding"), pick(["text/html; charset=utf-8", "application/ld+JSON", "image/png", "application/jsonx"]).alias("type"),
    )
    return op.compressible(rows, "page_id", 1024)


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linestatus WHEN 'O' THEN 'parse' ELSE 'serialize' END AS operation, l_returnflag = 'R' AS mutates, l_discount > 0.08 AS boundary, l_tax AS cpu, CASE WHEN l_quantity > 12 THEN 'a' ELSE 'b' END AS digest FROM lineitem),
 x AS (SELECT l_orderkey, CASE WHEN operation = 'parse' AND lead(operation) OVER w = 'serialize' AND lead(operation, 2) OVER w = 'parse' AND digest = lead(digest) OVER w AND digest = lead(digest, 2) OVER w AND NOT (mutates OR lead(mutates) OVER w OR lead(mutates, 2) OVER w OR lead(boundary) OVER w OR lead(boundary, 2) OVER w) THEN lead(cpu) OVER w + lead(cpu, 2) OVER w END AS waste FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, count(*) AS steps, count(waste) AS chains, round(coalesce(sum(waste), 0), 4) AS waste, CASE WHEN round(coalesce(sum(waste), 0), 4) >= 0.1 THEN 'detected' ELSE 'clean' END AS status FROM x GROUP BY ALL""")
def net12_chains(t):
    """NET-12 on orders: open items parse and finished ones serialize, returns change the content, discounts are boundaries."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linestatus") == "O", "parse").otherwise("serialize").alias("operation"), (F.col("l_returnflag") == "R").alias("mutates"), (F.col("l_discount") > 0.08).alias("boundary"), F.col("l_tax").alias("cpu"), F.when(F.col("l_quantity") > 12, "a").otherwise("b").alias("digest"), F.lit("json").alias("encoding"))
    return op.conversion_chains(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], 0.1)
