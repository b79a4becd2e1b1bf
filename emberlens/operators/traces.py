"""Calls within runs: islands of equal requests, loops, growing histories, serial siblings, and span trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import status
from ..functions.lineage import checkpointed


def islands(rows: DataFrame, by: list[str], order: list[str], same: Column) -> DataFrame:
    """``rows`` with ``island``: a new one wherever ``same`` (which may look back with ``previous``) is not true."""
    w = Window.partitionBy(*by).orderBy(*order)
    start = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("_new", start).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def previous(column: str, by: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*by).orderBy(*order))


def streaks(calls: DataFrame, run: str, order: str, request: str, failed: Column | None = None) -> DataFrame:
    """LLM-05: each run's longest streak of consecutive identical requests (the first of equal ones); failures end a streak."""
    rows = calls.select(run, order, request, F.coalesce(failed, F.lit(False)).alias("_failed") if failed is not None else F.lit(False).alias("_failed"))
    same = (previous(request, [run], [order]) == F.col(request)) & ~F.col("_failed") & ~previous("_failed", [run], [order])
    found = islands(rows, [run], [order], same).where(~F.col("_failed")).groupBy(run, "island").agg(F.count("*").alias("calls"), F.min(order).alias("first"))
    best = found.groupBy(run).agg(F.max(F.struct("calls", (-F.col("first")).alias("before"))).alias("b"))
    return best.select(run, F.col("b.calls").alias("calls"), (-F.col("b.before")).alias("first"), F.when(F.col("b.calls") > 1, "detected").otherwise("clean").alias("status"))


def chain_share(calls: DataFrame, run: str, request: str, min_calls: int = 3, min_share: float = 0.5) -> DataFrame:
    """LLM-05: share of a run's comparable calls that repeat an earlier request of the run."""
    per = calls.where(F.col(request).isNotNull()).groupBy(run).agg(F.count("*").alias("comparable_calls"), F.countDistinct(request).alias("distinct_calls"))
    out = per.withColumn("repeated_calls", F.col("comparable_calls") - F.col("distinct_calls"))
    return out.withColumn("status", status(F.col("comparable_calls") >= min_calls, F.col("repeated_calls") >= min_share * F.col("comparable_calls")))


def identical_calls(calls: DataFrame, run: str, call: list[str], most: int = 3) -> DataFrame:
    """LLM-10: the highest count of one (tool, arguments) pair within a run."""
    counts = calls.groupBy(run, *call).agg(F.count("*").alias("n"))
    out = counts.groupBy(run).agg(F.max("n").alias("max_identical"), F.count("*").alias("distinct_calls"))
    return out.withColumn("status", F.when(F.col("max_identical") > most, "detected").otherwise("clean"))


def iterations(calls: DataFrame, run: str, model_call: Column, most: int = 10, min_runs: int = 10) -> DataFrame:
    """LLM-10: model calls of a run, judged once there are enough runs; two runs or more make it sure."""
    per = calls.groupBy(run).agg(F.count_if(model_call).alias("model_calls"))
    all_ = per.agg(F.count("*").alias("runs"), F.count_if(F.col("model_calls") > most).alias("looping"))
    out = per.join(F.broadcast(all_))
    hit = F.col("model_calls") > most
    return out.withColumn("status", status(F.col("runs") >= min_runs, hit)).withColumn("confidence", F.when(hit & (F.col("looping") >= 2), "high").when(hit, "medium"))


def history_growth(calls: DataFrame, run: str, order: str, text: str, min_turns: int = 3) -> DataFrame:
    """LLM-14: characters sent when every turn carries all earlier ones, against sending each once."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sent = calls.select(run, order, F.coalesce(F.length(text), F.lit(0)).alias("own")).withColumn("sent", F.sum("own").over(w))
    agg = sent.groupBy(run).agg(F.count("*").alias("turns"), F.sum("own").cast("long").alias("own_chars"), F.sum("sent").cast("long").alias("sent_chars"))
    return agg.withColumn("status", status(F.col("turns") >= min_turns, F.col("sent_chars") > 2 * F.col("own_chars")))


def serial_runs(spans: DataFrame, parent: str, name: str, order: list[str], start: str, end: str, slack: float = 0.001, min_calls: int = 3) -> DataFrame:
    """JS-01: each parent's longest run of same-named siblings that wait for one another, by count and then wall time."""
    same = (previous(name, [parent], order) == F.col(name)) & (F.col(start) >= previous(end, [parent], order) - slack)
    found = islands(spans, [parent], order, same).groupBy(parent, "island").agg(F.count("*").alias("calls"), (F.max(end) - F.min(start)).alias("wall"), F.min(start).alias("first"))
    best = found.groupBy(parent).agg(F.max(F.struct("calls", "wall", (-F.col("first")).alias("before"))).alias("b"))
    return best.select(parent, F.col("b.calls").alias("calls"), F.col("b.wall").alias("wall")).withColumn("status", F.when(F.col("calls") >= min_calls, "detected").otherwise("clean"))


def complete_traces(spans: DataFrame, trace: str = "trace_id", span: str = "span_id", parent: str = "parent_id", bad: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Spans of traces that are whole, and one reason for each other trace: a malformed span or a missing parent drops all of a trace."""
    bad = F.lit(False) if bad is None else bad
    malformed = spans.where(F.coalesce(bad, F.lit(True))).select(trace, F.lit("malformed").alias("reason"))
    ids = spans.select(F.col(trace).alias("_t"), F.col(span).alias("_s")).distinct()
    child = spans.where(F.col(parent).isNotNull())
    orphan = child.join(ids, (F.col(trace) == F.col("_t")) & (F.col(parent) == F.col("_s")), "left_anti").select(trace, F.lit("orphaned").alias("reason"))
    skipped = malformed.unionByName(orphan).groupBy(trace).agg(F.min("reason").alias("reason"))
    return spans.join(skipped, trace, "left_anti"), skipped


def nearest_ancestor(spans: DataFrame, wanted: Column, trace: str = "trace_id", span: str = "span_id", parent: str = "parent_id") -> DataFrame:
    """``owner`` of each span: the nearest enclosing span that is ``wanted``, itself included, by pointer doubling.

    Each round doubles the distance that a pointer reaches, so log2 of the largest trace's spans rounds reach every root. A
    pointer that is still on its way then runs in a cycle of parents: its span has no owner and ``cycle`` is true."""
    most = spans.groupBy(trace).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    state = spans.select(F.col(trace).alias("t"), F.col(span).alias("s"), F.when(wanted, F.col(span)).alias("owner"), F.when(~wanted, F.col(parent)).alias("up"))
    for _ in range(max(1, most.bit_length() + 1)):
        above = state.select(F.col("t").alias("_t"), F.col("s").alias("_s"), F.col("owner").alias("_owner"), F.col("up").alias("_up"))
        state = state.join(above, (F.col("t") == F.col("_t")) & (F.col("up") == F.col("_s")), "left").select("t", "s", F.coalesce("owner", "_owner").alias("owner"), F.when(F.coalesce("owner", "_owner").isNull(), F.col("_up")).alias("up"))
        state = checkpointed(state)
        if state.where("up IS NOT NULL").isEmpty():
            break
    return spans.join(state.select(F.col("t").alias(trace), F.col("s").alias(span), "owner", F.col("up").isNotNull().alias("cycle")), [trace, span], "left")
