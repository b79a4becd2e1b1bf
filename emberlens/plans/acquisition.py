"""Limits, correlated reads and acquisition on events."""

from pyspark.sql import functions as F

from ..operators import acquisition as op
from ..streaming import correlation, limits
from .registry import query


@query("""WITH RECURSIVE r AS (SELECT user_id % 10 AS scope, event_id, user_id, epoch_us(ts) AS us, event_type <> 'error' AS starts, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS n FROM events),
 f AS (SELECT DISTINCT scope, 0::BIGINT AS n, CAST(NULL AS BIGINT) AS event_id, '' AS verdict, -1::BIGINT AS day, 0 AS count, CAST([] AS STRUCT(u BIGINT, t BIGINT)[]) AS started FROM r
  UNION ALL SELECT scope, n, event_id, verdict, day, count + CASE WHEN verdict = 'started' THEN 1 ELSE 0 END, CASE WHEN verdict = 'started' THEN list_append(list_filter(started, lambda s: us - s.t < 7200000000), struct_pack(u := user_id, t := us)) ELSE started END
  FROM (SELECT *, CASE WHEN soon THEN 'too soon' WHEN count >= 6 THEN 'over the cap' WHEN NOT starts THEN 'failed' ELSE 'started' END AS verdict FROM (SELECT r.scope, r.n, r.event_id, r.user_id, r.us, r.starts, f.started, r.us // 86400000000 AS day, CASE WHEN r.us // 86400000000 = f.day THEN f.count ELSE 0 END AS count,
   len(list_filter(f.started, lambda s: s.u = r.user_id AND r.us - s.t < 7200000000)) > 0 AS soon FROM f JOIN r ON r.scope = f.scope AND r.n = f.n + 1)))
SELECT scope, event_id, verdict FROM f WHERE n > 0""")
def scan_caps(t):
    """Requests under a cooldown and a daily cap: users in ten scopes, errors as requests that can't start."""
    rows = t.events.select((F.col("user_id") % 10).alias("scope"), "user_id", "ts", "event_id", (F.col("event_type") != "error").alias("starts"))
    return limits.within_limits(rows, "scope", "user_id", "ts", "event_id", "starts", 7200, 6)


SQL_READS = """a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), b AS (SELECT event_id, user_id, ts FROM events WHERE event_type IN ('click', 'view')),
 j AS (SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id, b.ts AS second_at FROM a LEFT JOIN b ON b.user_id = a.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR)"""


def _reads(t):
    rows = t.events.select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at"), "event_type")
    return rows.where("event_type = 'view'"), rows.where("event_type IN ('click', 'view')")


@query(f"WITH {SQL_READS} SELECT user_id, first_id, second_id FROM j")
def db05_correlated(t):
    """Views of a user with each view or click of the next six hours."""
    return correlation.correlated(*_reads(t), ["user_id"], 21600).select("user_id", "first_id", "second_id")


@query(f"""WITH {SQL_READS}, u AS (SELECT DISTINCT first_id FROM j JOIN events e ON e.event_id = first_id WHERE e.value > 20)
SELECT first_id, count(second_id) AS later, min(second_at) AS replaced_at, CASE WHEN count(second_id) > 0 AND first_id NOT IN (SELECT first_id FROM u) THEN 'detected' ELSE 'clean' END AS status FROM j GROUP BY first_id""")
def db05_dead_reads(t):
    """DB-05 on events: views replaced within six hours; a high value is a use."""
    return correlation.dead_reads(correlation.correlated(*_reads(t), ["user_id"], 21600), t.events.where("value > 20").select(F.col("event_id").alias("id")))


SQL_NODES = """w AS (SELECT DISTINCT event_type, epoch(date_trunc('day', ts))::BIGINT AS begin_at FROM events), e AS (SELECT event_type, epoch(date_trunc('day', ts))::BIGINT AS begin_at, floor(epoch(ts))::BIGINT AS sec FROM events),
 n AS (SELECT event_type, begin_at, 0 AS level, begin_at AS since, begin_at + 86400 AS until, CAST(NULL AS BIGINT) AS up_since, CAST(NULL AS BIGINT) AS up_until FROM w
  UNION ALL SELECT event_type, begin_at, level + 1, CASE half WHEN 0 THEN since ELSE (since + until) // 2 END, CASE half WHEN 0 THEN (since + until) // 2 ELSE until END, since, until FROM n, (VALUES (0), (1)) h(half) WHERE level < 3 AND until - since > 1),
 c AS (SELECT n.event_type, n.begin_at, level, since, until, up_since, up_until, count(e.sec) AS rows FROM n LEFT JOIN e ON e.event_type = n.event_type AND e.begin_at = n.begin_at AND e.sec >= since AND e.sec < until GROUP BY ALL),
 p AS (SELECT c.event_type, c.begin_at, c.level, c.since, c.until, c.rows, CASE WHEN c.rows < 16 THEN 'complete' WHEN c.level = 3 OR c.until - c.since <= 1 THEN 'truncated' ELSE 'split' END AS state FROM c LEFT JOIN c u ON u.event_type = c.event_type AND u.begin_at = c.begin_at AND u.level = c.level - 1 AND u.since = c.up_since AND u.until = c.up_until WHERE c.level = 0 OR u.rows >= 16)"""


def _plan(t):
    begin = F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp")))
    rows = t.events.select("event_type", begin.alias("begin_at"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (begin + 86400).alias("_end")).withColumn("_begin", F.col("begin_at"))
    return op.halving_plan(rows, ["event_type", "begin_at"], "at", "_begin", "_end", 16)


@query(f"WITH RECURSIVE {SQL_NODES} SELECT * FROM p")
def acquisition_plan(t):
    """Reads of each type's days through a reader of 16 rows."""
    return _plan(t)


@query(f"WITH RECURSIVE {SQL_NODES}, g AS (SELECT event_type, begin_at, count(*) AS reads, CAST(sum(CASE WHEN state = 'complete' THEN rows ELSE 0 END) AS BIGINT) AS rows, count(*) FILTER (state = 'truncated') AS cut FROM p GROUP BY ALL) SELECT event_type, begin_at, reads, rows, CASE WHEN cut > 0 THEN 'truncated' WHEN reads > 13 THEN 'too many reads' END AS refused FROM g")
def acquisition_coverage(t):
    """Whether the reads certify each day: thirteen at most."""
    return op.coverage(_plan(t), ["event_type", "begin_at"], 13)


@query("""WITH g AS (SELECT user_id, event_type, props, count(*) AS copies, count(DISTINCT floor(value / 25)) AS versions, min(floor(value / 25)) AS step FROM events GROUP BY ALL)
SELECT user_id, event_type, props, copies, versions, CASE WHEN versions = 1 THEN step END AS step FROM g""")
def acquisition_conflicts(t):
    """Copies of an event that agree, and those that don't: user, type and properties as identity, steps of value as payload."""
    rows = t.events.select("user_id", "event_type", "props", F.floor(F.col("value") / 25).cast("double").alias("step"))
    kept, conflicts = op.distinct_events(rows, ["user_id", "event_type", "props"], ["step"])
    return kept.withColumn("versions", F.lit(1).cast("long")).unionByName(conflicts, allowMissingColumns=True)
