import datetime as dt
import json

from emberlens.sources import profiles, schedules

START, END = dt.datetime(2024, 3, 30, tzinfo=dt.UTC), dt.datetime(2024, 4, 2, tzinfo=dt.UTC)


def test_cron():
    at = lambda *a: schedules.cron_times(*a, START, END)
    assert [t.day for t in at("0 12 * * *", "posix", "UTC")] == [30, 31, 1]
    # 02:30 does not exist in Berlin on 31 March 2024
    assert [t.isoformat() for t in at("30 2 * * *", "posix", "Europe/Berlin")] == ["2024-03-30T01:30:00+00:00", "2024-04-01T00:30:00+00:00"]
    assert [t.day for t in at("0 0 ? * MON *", "aws", "UTC")] == [1] and [t.day for t in at("0 0 1 * SUN", "posix", "UTC")] == [31, 1]


def test_occurrences(spark):
    rows = [("a", "rate(1 day)", None, None), ("b", "cron(0/30 6 * * ? *)", None, "UTC"), ("c", "61 * * * *", "posix", "UTC")]
    got = schedules.occurrences(spark.createDataFrame(rows, "job_id string, expression string, dialect string, timezone string"), START, END).collect()
    assert {j: sum(r.job_id == j for r in got) for j in "abc"} == {"a": 3, "b": 6, "c": 1}
    assert [r.problem is not None for r in got if r.job_id == "c"] == [True]


def test_profiles(spark):
    speed = {"shared": {"frames": [{"name": "main", "file": "a.py", "line": 1}, {"name": "f", "file": "a.py", "line": 5}]}, "profiles": [{"type": "sampled", "samples": [[0, 1, 1], [0]], "weights": [3, 1]}]}
    raw = spark.createDataFrame([("p", json.dumps(speed))], "profile string, text string")
    shares = {r.line: r.share for r in profiles.line_shares(profiles.speedscope(raw, "profile", "text"), "profile").collect()}
    assert shares == {1: 1.0, 5: 0.75}
    node = lambda i, name, children: {"id": i, "callFrame": {"functionName": name, "url": "u", "lineNumber": i}, "children": children}
    v8 = {"nodes": [node(1, "(root)", [2, 5]), node(2, "a", [3]), node(3, "b", [4]), node(4, "a2", []), node(5, "(idle)", [])], "samples": [4, 4, 3, 5]}
    got = {r.function: (r.self, r.inclusive) for r in profiles.cpuprofile(spark.createDataFrame([("p", json.dumps(v8))], "profile string, text string"), "profile", "text").collect()}
    assert got == {"(root)": (0, 3), "a": (0, 3), "b": (1, 3), "a2": (2, 2)}
    mem = {"total_num_allocations": 5, "total_bytes_allocated": 100, "top_allocations_by_size": [{"location": "f:a.py:3", "size": 60}, {"location": "f:a.py:3", "size": 10}], "top_allocations_by_count": [{"location": "g:b.py:9", "count": 4}], "metadata": {"peak_memory": 7}}
    rows = {(r.file, r.line): (r.bytes, r.n, r.total_bytes, r.peak_bytes) for r in profiles.memray(spark.createDataFrame([("p", json.dumps(mem))], "profile string, text string"), "profile", "text").collect()}
    assert rows == {("a.py", 3): (70, 0, 100, 7), ("b.py", 9): (0, 4, 100, 7)}


def test_deep_stacks_keep_their_outer_frames(spark):
    node = lambda i, children: {"id": i, "callFrame": {"functionName": f"f{i}", "url": "u", "lineNumber": i}, "children": children}
    v8 = {"nodes": [*(node(i, [i + 1]) for i in range(1, 400)), node(400, [])], "samples": [400, 400, 390]}
    got = {r.function: (r.self, r.inclusive) for r in profiles.cpuprofile(spark.createDataFrame([("p", json.dumps(v8))], "profile string, text string"), "profile", "text").collect()}
    assert len(got) == 400 and got["f1"] == (0, 3) and got["f390"] == (1, 3) and got["f391"] == (0, 2) and got["f400"] == (2, 2)
