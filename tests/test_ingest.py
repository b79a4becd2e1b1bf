"""Ingest by day, and labels that tell requests apart."""

from pyspark.sql import functions as F

from emberlens.operators import telemetry
from emberlens.streaming import activity


def test_ingest_adds_each_key_once_and_reads_its_own_days(spark, tmp_path):
    target = f"{tmp_path}/target"
    write = activity.ingest(target, ["id"], marker="done", day="day")
    batch = lambda rows: spark.createDataFrame(rows, "id int, day string, done boolean, text string")
    first = batch([(1, "a", False, "x"), (1, "a", False, "x"), (2, "b", True, "y")])
    for rows in (first, first, batch([(2, "b", True, "y"), (3, "b", False, "z"), (4, "c", True, "w")])):
        write(rows, 0)
    got = spark.read.schema(first.schema).parquet(target)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4]
    days = batch([(5, "b", True, "")]).select("day").distinct()
    plan = got.join(days, "day", "left_semi").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_labels(spark):
    many = lambda f: [f(k) for k in range(40)]
    cases = {
        "RequestId": (many(lambda k: f"r{k}"), "high"), "request-id": (many(lambda k: f"r{k % 6}"), "low"), "route": (many(lambda k: f"/orders/{k + 100}"), "high"), "shape": (many(lambda k: f"{k % 6}0000000"), "medium"), "plain": (many(lambda k: f"v{k}"), "medium"),
        "few": (many(lambda k: f"v{k % 6}"), None), "aws_trace_id": (many(lambda k: f"t{k % 5}"), None), "mixed": (["10000000", "x", *many(lambda k: f"{k % 6}0000000")], None), "mail": (many(lambda k: f"a{k % 6}@b.example"), "medium"), "requestidx": (many(lambda k: f"v{k % 6}"), None),
    }
    rows = [("m", n * 100 + k, {label: v}) for n, (label, (values, _)) in enumerate(cases.items()) for k, v in enumerate(values)]
    frame = spark.createDataFrame([*rows, ("cut", 1, {"email": "x"})], "metric string, n int, labels map<string,string>").repartition(4)
    complete = spark.createDataFrame([("m", True), ("cut", False)], "metric string, complete boolean")
    got = {(r.metric, r.label): (r.status, r.confidence, r.samples) for r in telemetry.label_cardinality(frame, "metric", "n", "labels", complete, 20, 5).collect()}
    for label, (values, confidence) in cases.items():
        assert got["m", label] == ("detected" if confidence else "clean", confidence, list(dict.fromkeys(values))[:5]), label
    assert got["cut", "email"][:2] == ("omitted", None)
    assert telemetry.label_cardinality(frame.where(F.lit(False)), "metric", "n", "labels", complete, 20, 5).count() == 0
