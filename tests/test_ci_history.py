"""Run histories against plain rules."""

from pyspark.sql import functions as F

from emberlens.operators import ci_history


def picks(n):
    """Ends first, then ever finer halvings, each index once, and what no halving named."""
    out = list(dict.fromkeys([0, n - 1]))
    parts = 1
    while parts <= 2 * n:
        parts *= 2
        out += [i for k in range(1, parts, 2) if (i := k * (n - 1) // parts) not in out or out.index(i) >= len(out)]
        out = list(dict.fromkeys(out))
    return out + [i for i in range(n) if i not in out]


def test_turns_are_spread_by_bisection(spark):
    sizes = [*range(1, 41), 63, 64, 65, 100, 257]
    runs = [("r", f"w{n:03}", n * 1000 + i, i, "completed", "success") for n in sizes for i in range(n)]
    runs += [("r", "w001", 1, 1, "queued", None), ("r", "w002", 2, 9, "completed", "action_required"), ("q", "w", 3, 0, "completed", None)]
    frame = spark.createDataFrame(runs, "repo string, path string, id long, at int, status string, conclusion string").repartition(3)
    rows = ci_history.sampling_turns(frame, "repo", "path", ["at"], "status", "conclusion").collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.turn):
        got.setdefault((r.repo, r.path), []).append(r["at"])
    assert got == {("r", f"w{n:03}"): picks(n) for n in sizes} | {("q", "w"): [0]}
    order = [(r.turn, -int(r.path[1:]), r.path) for r in sorted((r for r in rows if r.repo == "r"), key=lambda r: r.place)]
    assert order == sorted(order) and len(order) == sum(sizes)


def test_one_workflow_is_ranked_by_many_tasks(spark):
    from pyspark.sql import Window

    from emberlens.operators import ci, quantiles

    runs = spark.range(6000).select(F.when(F.col("id") % 3 > 0, "r").alias("repo"), F.lit("w").alias("path"), F.col("id").alias("at"), F.lit("completed").alias("status"), F.lit("success").alias("conclusion"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = ci_history.sampling_turns(runs, "repo", "path", ["at"], "status", "conclusion")
        order = ci.sampling_order(runs, "repo", ["at"], 4)
        assert all("Window" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (turns, order))
        rows = quantiles.ranked(runs, ["repo"], [F.desc("at")], "rank", "n")
        w = Window.partitionBy("repo")
        plain = runs.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("at"))), "n": F.count("*").over(w)})
        assert sorted(map(str, rows.collect())) == sorted(map(str, plain.collect()))
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 2
        assert sorted(r.place for r in turns.where("repo IS NULL").collect()) == list(range(1, 2001))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cut_listings_certify_what_is_newer_than_their_oldest(spark):
    rows = [(r, i, t) for r in ("cut", "whole", "unknown", "less") for i, t in enumerate((5, 5, 6, 9))]
    frame = spark.createDataFrame(rows, "repo string, id int, created int")
    totals = spark.createDataFrame([("cut", 5, 1), ("whole", 4, 1), ("unknown", None, 1), ("less", 2, 1), ("empty", 3, 1)], "repo string, total int, since int")
    got = {}
    for r in ci_history.certified(frame, totals, "repo", "created").collect():
        got.setdefault((r.repo, r.window_start, r.start_exclusive), set()).add(r.id)
    assert got == {("cut", 5, True): {2, 3}, ("whole", 1, False): {0, 1, 2, 3}, ("unknown", 1, False): {0, 1, 2, 3}, ("less", 1, False): {0, 1, 2, 3}}


def test_workflows_and_the_gate(spark):
    runs = [("r", "a", 1, "completed", "success", "push", 1), ("r", "a", 2, "completed", "success", "push", 2), ("r", "a", 3, "completed", "action_required", "pull", None), ("r", "a", 4, "queued", None, None, 1), ("r", "a", 5, "completed", "", "push", 3), ("r", "b", 6, "queued", None, "push", 1)]
    frame = spark.createDataFrame(runs, "repo string, path string, id int, status string, conclusion string, event string, attempt int")
    a, b = sorted(ci_history.workflow_rollup(frame, "repo", "path", "status", "conclusion", "event", "attempt").collect(), key=lambda r: r.path)
    assert (a.runs, a.completed, a.executed, a.awaiting, a.retried) == (5, 4, 3, 1, 2) and (b.runs, b.completed, b.executed) == (1, 0, 0)
    assert [tuple(x) for x in a.by_conclusion] == [("success", 2), ("action_required", 1), ("completed", 1), ("queued", 1)] and [tuple(x) for x in a.by_event] == [("push", 3), ("None", 1), ("pull", 1)]
    found = spark.createDataFrame([("a", "detected", "high"), ("b", "detected", "high"), ("c", "clean", None)], "path string, status string, confidence string")
    got = {r.path: (r.status, r.confidence, r.runs) for r in ci_history.gated(found, frame, "path", "id", 5).collect()}
    assert got == {"a": ("detected", "high", 5), "b": ("omitted", None, 1), "c": ("omitted", None, 0)}
    assert ci_history.gated(found.where(F.lit(False)), frame, "path", "id").count() == 0


def test_tasks_of_queries_do_not_grow_with_the_rows(spark):
    from emberlens.plans.registry import QUERIES, TASK_BYTES

    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    for name in ("ci01_rechecks", "ci02_blind_rechecks", "ci03_flaky_jobs"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) == TASK_BYTES <= 16 << 20
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
