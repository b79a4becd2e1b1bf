"""Trace rules on conversations and line items."""

from pyspark.sql import functions as F

from ..operators import traces as op
from .registry import query


@query("""
WITH c AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS brk FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 i AS (SELECT conv_id, turn, sum(brk) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c),
 g AS (SELECT conv_id, island, count(*) AS calls, min(turn) AS first FROM i GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY calls DESC, first) AS n FROM g)
SELECT conv_id, calls, first, CASE WHEN calls > 1 THEN 'detected' ELSE 'clean' END AS status FROM r WHERE n = 1
""")
def llm05_streaks(t):
    """LLM-05 on conversations: equal consecutive roles as equal requests."""
    return op.streaks(t.conversations, "conv_id", "turn", "role")


@query("""
WITH p AS (SELECT conv_id, count(*) AS comparable_calls, count(DISTINCT text) AS distinct_calls FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
SELECT *, comparable_calls - distinct_calls AS repeated_calls, CASE WHEN comparable_calls < 3 THEN 'omitted' WHEN comparable_calls - distinct_calls >= 0.5 * comparable_calls THEN 'detected' ELSE 'clean' END AS status FROM p
""")
def llm05_chain_share(t):
    """LLM-05 on conversations: repeated texts of a conversation."""
    return op.chain_share(t.conversations, "conv_id", "text")


@query("""
WITH n AS (SELECT conv_id, role, text, count(*) AS n FROM conversations GROUP BY ALL)
SELECT conv_id, max(n) AS max_identical, count(*) AS distinct_calls, CASE WHEN max(n) > 3 THEN 'detected' ELSE 'clean' END AS status FROM n GROUP BY conv_id
""")
def llm10_identical_calls(t):
    """LLM-10 on conversations: role as tool, text as arguments."""
    return op.identical_calls(t.conversations, "conv_id", ["role", "text"])


@query("""
WITH p AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS model_calls FROM conversations GROUP BY conv_id), a AS (SELECT count(*) AS runs, count(*) FILTER (model_calls > 3) AS looping FROM p)
SELECT p.*, a.*, CASE WHEN runs < 10 THEN 'omitted' WHEN model_calls > 3 THEN 'detected' ELSE 'clean' END AS status, CASE WHEN model_calls > 3 THEN CASE WHEN looping >= 2 THEN 'high' ELSE 'medium' END END AS confidence FROM p, a
""")
def llm10_iterations(t):
    """LLM-10 on conversations: assistant turns as model calls."""
    return op.iterations(t.conversations, "conv_id", F.col("role") == "assistant", most=3)


@query("""
WITH s AS (SELECT conv_id, turn, coalesce(length(text), 0) AS own, sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS sent FROM conversations)
SELECT conv_id, count(*) AS turns, CAST(sum(own) AS BIGINT) AS own_chars, CAST(sum(sent) AS BIGINT) AS sent_chars, CASE WHEN count(*) < 3 THEN 'omitted' WHEN sum(sent) > 2 * sum(own) THEN 'detected' ELSE 'clean' END AS status FROM s GROUP BY conv_id
""")
def llm14_history_growth(t):
    """LLM-14 on conversations: what re-sending the history costs."""
    return op.history_growth(t.conversations, "conv_id", "turn", "text")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CAST(epoch(l_shipdate) / 86400 AS DOUBLE) AS start, epoch(l_shipdate) / 86400 + 1.0 AS stop FROM lineitem),
 b AS (SELECT *, CASE WHEN lag(l_returnflag) OVER w = l_returnflag AND start >= lag(stop) OVER w - 0.001 THEN 0 ELSE 1 END AS brk FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY start, l_linenumber, l_partkey, l_suppkey, l_returnflag)),
 i AS (SELECT *, sum(brk) OVER (PARTITION BY l_orderkey ORDER BY start, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS island FROM b),
 g AS (SELECT l_orderkey, island, count(*) AS calls, max(stop) - min(start) AS wall, min(start) AS first FROM i GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY calls DESC, wall DESC, first) AS n FROM g)
SELECT l_orderkey, calls, wall, CASE WHEN calls >= 3 THEN 'detected' ELSE 'clean' END AS status FROM r WHERE n = 1
""")
def js01_serial_runs(t):
    """JS-01 on orders: line items of one return flag as same-named calls of a day each."""
    start = (F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400).cast("double")
    spans = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", start.alias("start"), (start + 1.0).alias("stop"))
    return op.serial_runs(spans, "l_orderkey", "l_returnflag", ["start", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], "start", "stop")
