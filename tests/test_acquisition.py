"""Limits, correlated reads and acquisition against plain folds, on tables and on streams."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlens.operators import acquisition
from emberlens.streaming import correlation, limits

BEGIN = datetime(2024, 3, 1)


def requests(seed, n, scopes=3):
    rng = random.Random(seed)
    return [(rng.randrange(scopes), k, f"r{rng.randrange(5)}", BEGIN + timedelta(seconds=rng.randrange(3 * 86400)), rng.random() < 0.8) for k in range(n)]


def fold(rows, cooldown, daily):
    out, count, last = {}, Counter(), {}
    for scope, i, key, at, starts in sorted(rows, key=lambda r: (r[3], r[1])):
        if (scope, key) in last and (at - last[scope, key]).total_seconds() < cooldown:
            out[i] = "too soon"
        elif count[scope, at.date()] >= daily:
            out[i] = "over the cap"
        elif not starts:
            out[i] = "failed"
        else:
            out[i], last[scope, key] = "started", at
            count[scope, at.date()] += 1
    return out


SCHEMA = "scope long, id long, key string, at timestamp, starts boolean"


def test_only_starts_count(spark):
    rows = requests(1, 900)
    # at the very end of a cooldown, over midnight, and ties
    rows += [(9, 1000 + k, "x", BEGIN + timedelta(seconds=s), True) for k, s in enumerate((0, 10, 3599, 3600, 3600, 86390, 86400 + 3589, 86400 + 3590))]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.id: r.verdict for r in limits.within_limits(frame, "scope", "key", "at", "id", "starts", 3600, 7).collect()}
    want = fold(rows, 3600, 7)
    assert got == want and set(want.values()) == {"started", "failed", "too soon", "over the cap"}
    assert [want[1000 + k] for k in range(8)] == ["started", "too soon", "too soon", "started", "too soon", "started", "too soon", "started"]
    odd = spark.createDataFrame([(None, 1, "a", BEGIN, True), (None, 2, None, BEGIN, None), (1, 3, "a", None, True)], SCHEMA)
    assert {r.id: r.verdict for r in limits.within_limits(odd, "scope", "key", "at", "id", "starts", 60, 1).collect()} == {1: "started", 2: "over the cap", 3: None}
    assert limits.within_limits(odd.where("id < 0"), "scope", "key", "at", "id", "starts", 60, 1).count() == 0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def stream(spark, folder, schema, files):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("at", "4 days")


def run(query, folder):
    q = query.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return query.sparkSession.read.parquet(f"{folder}/out")


def test_a_stream_gives_the_fold_of_the_table(spark, rocks, tmp_path):
    """Rows arrive in four files in no order; two late ones move the watermark past all of them."""
    rows = requests(2, 160, 2)
    random.Random(3).shuffle(rows)
    later = [[(s, 9000 + 2 * k + s, "end", BEGIN + timedelta(days=30 + 10 * k), True) for s in range(2)] for k in range(2)]
    files = [rows[:40], rows[40:80], rows[80:120], rows[120:], *later]
    out = run(limits.limits_stream(stream(spark, str(tmp_path), SCHEMA, files), 3600, 4), str(tmp_path))
    got = {r.id: r.verdict for r in out.collect() if r.id < 9000}
    assert got == fold(rows, 3600, 4)


def test_pairs_of_reads_on_a_table_and_on_streams(spark, tmp_path):
    rng = random.Random(4)
    read = lambda n, first: [(f"q{rng.randrange(6)}" if rng.random() < 0.6 else "hot", first + k, BEGIN + timedelta(seconds=rng.randrange(4 * 3600))) for k in range(n)]
    a, b = read(120, 0), read(150, 1000)
    b += [(a[0][0], 2000, a[0][2]), (a[0][0], 2001, a[0][2] + timedelta(seconds=600)), (a[0][0], 2002, a[0][2] + timedelta(seconds=600, microseconds=1))]
    want = set()
    for key, i, at in a:
        hits = [j for k, j, t in b if k == key and at < t <= at + timedelta(seconds=600)]
        want |= {(i, j) for j in hits} or {(i, None)}
    schema = "request string, id long, at timestamp"
    x, y = (spark.createDataFrame(r, schema) for r in (a, b))
    pairs = correlation.correlated(x, y, ["request"], 600)
    assert {(r.first_id, r.second_id) for r in pairs.collect()} == want and pairs.count() == len(want)
    used = spark.createDataFrame([(i,) for _, i, _ in a[:40]], "id long")
    found = {r.first_id: r.status for r in correlation.dead_reads(pairs, used).collect()}
    assert found == {i: "detected" if (i, None) not in want and i >= 40 else "clean" for _, i, _ in a}
    end = [[("end", 9000 + k, BEGIN + timedelta(days=20 + 10 * k))] for k in range(2)]
    sides = [stream(spark, f"{tmp_path}/{n}", schema, [r[: len(r) // 2], r[len(r) // 2 :], *end]) for n, r in (("a", a), ("b", b))]
    out = run(correlation.correlated(*sides, ["request"], 600), str(tmp_path))
    assert {(r.first_id, r.second_id) for r in out.collect() if r.first_id < 9000} == want


def halve(times, a, b, limit, depth, level=0):
    """The reads as a recursion makes them."""
    n = sum(a <= t < b for t in times)
    if n < limit:
        return [(level, a, b, n, "complete")]
    if level == depth or b - a <= 1:
        return [(level, a, b, n, "truncated")]
    m = (a + b) // 2
    return [(level, a, b, n, "split"), *halve(times, a, m, limit, depth, level + 1), *halve(times, m, b, limit, depth, level + 1)]


def test_halving_reads_as_the_recursion_does(spark):
    rng = random.Random(5)
    groups = {g: (rng.randrange(100), w, [rng.randrange(w) if rng.random() < 0.7 else w // 3 for _ in range(n)]) for g, (w, n) in enumerate([(3600, 40), (3600, 9), (100, 200), (7, 60), (3, 50), (1, 20), (2, 11), (1000, 1)])}
    rows = [(g, a + t, a, a + w) for g, (a, w, times) in groups.items() for t in times] + [(0, groups[0][0] - 1, groups[0][0], groups[0][0] + 3600)]
    frame = spark.createDataFrame(rows, "g int, at long, a long, b long").repartition(3)
    for limit, depth in ((10, 3), (3, 5), (1000, 3), (1, 0)):
        plan = acquisition.halving_plan(frame, ["g"], "at", "a", "b", limit, depth)
        got = defaultdict(list)
        for r in plan.collect():
            got[r.g].append((r.level, r.since, r.until, r.rows, r.state))
        want = {g: sorted(halve([a + t for t in times], a, a + w, limit, depth)) for g, (a, w, times) in groups.items()}
        assert {g: sorted(x) for g, x in got.items()} == want
        cover = {r.g: (r.reads, r.rows, r.refused) for r in acquisition.coverage(plan, ["g"]).collect()}
        for g, reads in want.items():
            cut = any(r[4] == "truncated" for r in reads)
            assert cover[g] == (len(reads), sum(r[3] for r in reads if r[4] == "complete"), "truncated" if cut else "too many reads" if len(reads) > 15 else None)


def test_copies_that_differ_are_conflicts(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("b", 1, None), ("b", 1, None), ("c", 1, None), ("c", 1, "x"), ("d", None, "y"), (None, 5, "z"), (None, 6, "z")] + [("hot", 3, "w")] * 500
    kept, conflicts = acquisition.distinct_events(spark.createDataFrame(rows, "id string, n int, text string").repartition(5), ["id"], ["n", "text"])
    assert sorted((tuple(r) for r in kept.collect()), key=str) == [("a", 1, "x", 2), ("b", 1, None, 2), ("d", None, "y", 1), ("hot", 3, "w", 500)]
    assert {tuple(r) for r in conflicts.select(F.col("id"), "copies", "versions").collect()} == {("c", 2, 2), (None, 2, 2)}
