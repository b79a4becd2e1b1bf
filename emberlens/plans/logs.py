"""Log and cache rules on events and documents."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import logs as op
from .registry import case, query

STEPS = (("[[:xdigit:]]{8}(-[[:xdigit:]]{4}){3}-[[:xdigit:]]{12}", "<uuid>"), ("\\d{4}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d([.,]\\d+)?(Z|[+-]\\d\\d:?\\d\\d)?", "<ts>"), ("[[:xdigit:]]{8,}", "<hex>"), ("\\d+", "<n>"), ("[[:space:]]+", " "))
SQL_TEMPLATE = "trim(" + "regexp_replace(" * 5 + "substring(MESSAGE, 1, 400)" + "".join(f", '{p}', '{n}', 'g')" for p, n in STEPS) + ")"
SQL_HOLDERS = """p AS (SELECT event_type AS cache, json_extract_string(props, '$.k') AS k, count(*) AS lookups, count(*) FILTER (value < 5) AS hits, count(DISTINCT CASE WHEN NOT value < 5 THEN user_id END) AS missing FROM events GROUP BY ALL),
 h AS (SELECT cache, least(missing, 20) AS missed_by, count(*) AS keys, sum(lookups) AS lookups, sum(hits) AS hits, sum(missing) AS missing_holders FROM p GROUP BY ALL)"""


def _holders(t):
    looked = t.events.select(F.col("event_type").alias("cache"), F.get_json_object("props", "$.k").alias("k"), "user_id", "value")
    return op.cache_holders(looked, "cache", "k", "user_id", F.col("value") < 5)


@query(f"WITH {SQL_HOLDERS} SELECT * FROM h")
def llm12_cache_holders(t):
    """LLM-12 fold: event type as cache, property k as key, user as holder."""
    return _holders(t)


@query(f"""WITH {SQL_HOLDERS}, a AS (SELECT cache, sum(lookups) AS lookups, sum(hits) AS hits, sum(CASE WHEN missed_by >= 2 THEN missing_holders - keys ELSE 0 END) AS redundant FROM h GROUP BY cache),
 s AS (SELECT *, CASE WHEN lookups < 100 THEN 'omitted' WHEN redundant > 20 AND redundant > 0.1 * lookups THEN 'detected' ELSE 'clean' END AS status FROM a)
SELECT *, CASE WHEN status = 'detected' THEN sha256('["events","LLM-12","cache:' || cache || '","isolated-caches"]') END AS fingerprint FROM s""")
def llm12_redundant_share(t):
    """LLM-12 rule on the fold, with fingerprints."""
    return op.isolated_caches(_holders(t), "cache", "events")


@query(f"""WITH f AS (SELECT source, {SQL_TEMPLATE.replace("MESSAGE", "text")} AS template, n_chars % 60 AS slot FROM documents),
 c AS (SELECT source, template, count(*) AS n, count(DISTINCT slot) AS slots FROM f GROUP BY ALL)
SELECT source, CASE WHEN n < 2 THEN '<other>' ELSE template END AS template, sum(n) AS occurrences, sum(slots) AS slots, count(*) AS templates FROM c GROUP BY ALL""")
def obs11_log_templates(t):
    """OBS-11 templates: a document as a message of its source."""
    return op.template_counts(t.documents, "source", F.col("text"), F.col("n_chars") % 60, fold_below=2)


@query(f"""WITH f AS (SELECT event_type, {SQL_TEMPLATE.replace("MESSAGE", "(event_type || ' ' || props)")} AS template, CAST(user_id AS VARCHAR) || '/' || CAST(date_trunc('second', ts) AS VARCHAR) AS slot FROM events),
 c AS (SELECT event_type, template, count(*) AS n, count(DISTINCT slot) AS slots FROM f GROUP BY ALL),
 o AS (SELECT event_type, CASE WHEN n < 10 THEN '<other>' ELSE template END AS template, sum(n) AS occurrences, sum(slots) AS slots, count(*) AS templates FROM c GROUP BY ALL),
 e AS (SELECT event_type, sum(occurrences) AS events FROM o GROUP BY ALL)
SELECT o.*, events, CASE WHEN events < 100 THEN 'omitted' WHEN occurrences > 50 AND occurrences > 0.2 * events AND template <> '<other>' THEN 'detected' ELSE 'clean' END AS status FROM o JOIN e USING (event_type)""")
def obs11_repeat_share(t):
    """OBS-11 rule: messages of each event type, slots of a user and a second."""
    slot = F.struct("user_id", F.date_trunc("second", "ts"))
    return op.repeated_lines(op.template_counts(t.events, "event_type", F.concat_ws(" ", "event_type", "props"), slot), "event_type")


SQL_SIZES = "s AS (SELECT source, CAST(least(ceil(n_chars / 512.0), 65) AS INTEGER) AS bucket, count(*) AS events, sum(n_chars) AS chars, max(n_chars) AS max_chars FROM documents GROUP BY ALL)"


@query(f"WITH {SQL_SIZES} SELECT * FROM s")
def obs17_size_histogram(t):
    """OBS-17 histogram of document sizes by source."""
    return op.size_histogram(t.documents, ["source"], F.col("n_chars"))


@query(f"WITH {SQL_SIZES}, a AS (SELECT source, sum(events) AS events, sum(chars) AS chars, sum(CASE WHEN bucket > 16 THEN chars ELSE 0 END) AS large_chars FROM s GROUP BY source) SELECT *, CASE WHEN events < 20 THEN 'omitted' WHEN large_chars > 0.25 * chars THEN 'detected' ELSE 'clean' END AS status FROM a")
def obs17_oversized(t):
    """OBS-17 rule: characters in documents beyond 8192."""
    return op.oversized(op.size_histogram(t.documents, ["source"], F.col("n_chars")), ["source"], 8192, 0.25, 20)


MESSAGES = (
    ("basic", "Authorization: Bearer abc.def", "Authorization: <redacted> <redacted>"), ("key", "API_KEY=abcdef&x=1", "API_KEY=<redacted>&x=1"), ("mail", "to a.b@c.example.org now", "to <email> now"),
    ("ip", "from 10.1.2.3 and <n>.<n>.<n>.<n>, not 1.2.3.4.5", "from <ip> and <ip>, not 1.2.3.4.5"), ("ip6", "at fe80:0:0:1 or ::1 end", "at <ip> or <ip> end"),
    ("token", "id a1b2c3d4e5f6a7b8c9d0e1f2g3 short a1b2", "id <token> short a1b2"), ("case", "x AbcdefghijklmnopqrstuvwxyzABCDEF y", "x <token> y"), ("word", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz"), ("json", '{"password": "hunter2"}', '{"password": "<redacted>"}'),
)


@case("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{out}')" for k, _, out in MESSAGES) + ") v(message, redacted)")
def redaction_cases(t):
    """What redaction makes of messages."""
    rows = t.spark.createDataFrame([m[:2] for m in MESSAGES], "message string, text string")
    return rows.select("message", text.redacted(F.col("text")).alias("redacted"))


@case("SELECT * FROM (VALUES ('id', 'request <hex> took <n> ms'), ('time', '<ts> start'), ('uuid', 'job <uuid> done')) v(message, template)")
def template_cases(t):
    """What a template keeps of messages."""
    rows = [("id", "request 7f3a9c2d81be  took 15 ms"), ("time", "2024-01-02T03:04:05.678Z start"), ("uuid", "job 123e4567-e89b-12d3-a456-426614174000 done ")]
    return t.spark.createDataFrame(rows, "message string, text string").select("message", text.template(F.col("text")).alias("template"))


@case("SELECT * FROM (VALUES ('g', 'retry', 120, 60, 'detected'), ('g', 'handled', 100, 100, 'clean'), ('g', 'START RequestId: <uuid>', 100, 100, 'clean')) v(log_group, template, occurrences, slots, status)")
def obs11_exemptions(t):
    """OBS-11: a line of the platform, or one of each request, is no repeated line."""
    counts = t.spark.createDataFrame([("g", "retry", 120, 60), ("g", "handled", 100, 100), ("g", "START RequestId: <uuid>", 100, 100)], "log_group string, template string, occurrences long, slots long")
    calls = t.spark.createDataFrame([("g", 50, 50)], "log_group string, invocations long, invocation_slots long")
    return op.repeated_lines(counts, "log_group", invocations=calls).drop("events")
