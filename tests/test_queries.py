"""Every registered query against its SQL on the smallest tables, and the operators' own edge cases."""

import decimal
import os

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def registered():
    from emberlens.plans.registry import ORACLES

    return sorted(ORACLES)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", registered())
def test_query_equals_its_sql(spark, duck, name):
    from emberlens.plans.registry import ORACLES, QUERIES

    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = duck.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=repr)


def cases():
    import static_cases  # noqa: F401

    from emberlens.plans.registry import CASES

    return sorted(CASES)


@pytest.mark.parametrize("name", cases())
def test_case_equals_its_rows(spark, name):
    import duckdb

    from emberlens.plans.registry import CASES, Tables

    make, sql = CASES[name]
    df = make(Tables(spark, DATA))
    columns = sorted(df.columns)
    expected = duckdb.connect().sql(sql)
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=repr)


@needs_data
def test_every_query_reads_a_table():
    from emberlens.plans.registry import CASES, ORACLES, QUERIES

    import re

    assert all(re.search(rf"\b(?:{'|'.join(TABLES)})\b", sql) for sql in ORACLES.values()) and not QUERIES.keys() & CASES.keys()


@needs_data
def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"status", "fingerprint"} <= set(rows[0].asDict())


def test_fingerprint_is_the_hash_of_canonical_json(spark):
    import hashlib
    import json

    from pyspark.sql import functions as F

    from emberlens.functions.contract import fingerprint

    parts = ["github:some/place", "OBS-01", "file:config/production.yaml", 'log "level"']
    expected = hashlib.sha256(json.dumps(parts, separators=(",", ":")).encode()).hexdigest()
    assert spark.range(1).select(fingerprint(*map(F.lit, parts)).alias("f")).first().f == expected


def test_too_little_evidence_is_omitted(spark):
    from pyspark.sql import functions as F

    from emberlens.operators import telemetry

    rows = [("few", f"2024-01-{d:02d} 00:00:00", 0.01) for d in range(1, 20)] + [("many", f"2024-01-{1 + k % 20:02d} {k % 24:02d}:00:00", 0.01) for k in range(200)] + [("bad", "2024-01-01 00:00:00", float("nan"))]
    df = spark.createDataFrame(rows, "r string, ts string, share double").withColumn("ts", F.to_timestamp("ts"))
    got = {r.r: (r.status, r.confidence) for r in telemetry.over_provisioned(df, "r", "ts", F.col("share")).collect()}
    assert got == {"few": ("omitted", None), "many": ("detected", "high")}


def test_failures_end_a_streak(spark):
    from pyspark.sql import functions as F

    from emberlens.operators import traces

    df = spark.createDataFrame([(1, 1, "a", False), (1, 2, "a", True), (1, 3, "a", False), (1, 4, "a", False), (2, 1, "a", False)], "run int, turn int, request string, failed boolean")
    got = {r.run: (r.calls, r.first, r.status) for r in traces.streaks(df, "run", "turn", "request", F.col("failed")).collect()}
    assert got == {1: (2, 3, "detected"), 2: (1, 1, "clean")}


def test_accept_encoding(spark):
    from pyspark.sql import functions as F

    from emberlens.operators.network import accept_quality

    rows = [("gzip, br;q=0.5", 1.0), ("*;q=0.3", 0.3), ("gzip;q=0, *", 0.0), ("br", 0.0), ("GZIP ; q=0.8", 0.8)]
    got = [r.q for r in spark.createDataFrame([(h,) for h, _ in rows], "h string").select(accept_quality(F.col("h"), "gzip").alias("q")).collect()]
    assert got == [q for _, q in rows]


def test_static_python(spark):
    from emberlens.operators import static_python as op

    source = "import re\nimport time\nimport json\n\n\ndef load(items, cache={}):\n    out = ''\n    for i in range(len(items)):\n        pattern = re.compile('a+')\n        out += 'x'\n        items.pop(0)\n    return out\n    print(out)\n\n\nasync def wait():\n    time.sleep(1)\n\n\ndef read(path):\n    log.info(f'reading {path}')\n    return open(path).read()\n"
    test = "def test_two():\n    assert load([1])\n    assert load([2])\n\n\ndef test_none():\n    load([])\n"

    table = op.facts(spark.createDataFrame([("app/load.py", source), ("tests/test_load.py", test), ("app/broken.py", "def ("), ("app/empty.py", None)], "path string, text string"))
    found = {(r.check_id, r.file.split("/")[-1]) for r in op.hits(table).collect()}
    expected = {"CODE-C1.1", "CODE-C3.1", "CODE-C3.3", "CODE-C3.7", "CODE-C6.6", "CODE-C6.7", "CODE-C10.4", "CODE-C11.4", "OBS-02"}
    assert expected <= {c for c, f in found if f == "load.py"} and {("TST-01", "test_load.py"), ("TST-06", "test_load.py")} <= found
    assert {r.file: r.status for r in op.coverage(table).collect()} == {"app/load.py": "evaluated", "tests/test_load.py": "evaluated", "app/broken.py": "omitted", "app/empty.py": "evaluated"}
    assert len({(r.check_id, r.file, r.identity) for r in op.hits(table).collect()}) == op.hits(table).count()


def test_file_scan(spark, tmp_path):
    from emberlens.sources import files

    for path, raw in {"a.py": b"x = 1\n", "sub/b.txt": "é".encode(), "node_modules/c.js": b"1", "d.min.js": b"1", "poetry.lock": b"1", "e.bin": b"a\0b", "f.txt": b"\xff\xfe\xfa", "g.txt": b"z" * 50}.items():
        target = tmp_path / path
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(raw)
    kept, skipped = files.scan(files.read_tree(spark, str(tmp_path)), files.Limits(file_bytes=20))
    assert {r.path: r.text for r in kept.collect()} == {"a.py": "x = 1\n", "sub/b.txt": "é"}
    assert {r.reason: r.n for r in skipped.collect()} == {"excluded folder": 1, "minified": 1, "lock file": 1, "binary": 1, "not UTF-8": 1, "too large": 1}
    assert files.content_sha(kept).first().files == 2


def test_segments_and_jobs(spark):
    import json

    from emberlens.sources import evidence

    doc = {"id": "1", "name": "a", "start_time": 1.0, "end_time": 3.0, "subsegments": [{"id": "2", "name": "b", "start_time": 1.5, "end_time": 2.0, "fault": True, "subsegments": [{"id": "3", "name": "c"}]}]}
    got = {r.span_id: (r.parent_id, r.failed) for r in evidence.segments(spark.createDataFrame([("t", json.dumps(doc))], "trace_id string, document string")).collect()}
    assert got == {"1": (None, False), "2": ("1", True), "3": ("2", False)}
    rows = [(1, 1, "j", 1, "success", ["ubuntu-latest"], "GitHub Actions", "2024-01-01T00:00:00Z", "2024-01-01T00:00:05Z", "2024-01-01T00:01:05Z"), (1, 2, "k", 1, "success", ["self-hosted"], None, "2024-01-01T00:00:10Z", "2024-01-01T00:00:05Z", "2024-01-01T00:01:05Z"), (1, 3, "l", 1, None, None, None, "2024-01-01T00:00:00", None, None)]
    got = {r.id: (r.runner, r.vcpus, r.seconds, r.counted) for r in evidence.jobs(spark.createDataFrame(rows, evidence.JOBS)).collect()}
    assert got == {1: ("hosted", 4, 60, True), 2: ("self-hosted", None, None, False), 3: ("unknown", None, None, False)}


@needs_data
def test_streams_equal_batches(spark, tmp_path):
    from pyspark.sql import functions as F

    from emberlens.streaming import activity

    batch = spark.read.parquet(f"{DATA}/events.parquet")
    batch.unionByName(batch.limit(50)).repartition(3).write.parquet(f"{tmp_path}/events")
    target = f"{tmp_path}/target"
    for turn in range(2):
        stream = activity.distinct_events(activity.events(spark, f"{tmp_path}/events", batch.schema, late="10000 days"), "event_id")
        activity.run_once(stream, f"{tmp_path}/checkpoint{turn}", activity.ingest(target, ["event_id"]))
        assert spark.read.parquet(target).count() == batch.count()
    days = {}

    def last(df, number):
        days.update({(r.event_type, r.period): r.n for r in df.collect()})

    stream = activity.activity(activity.events(spark, target, batch.schema), "event_type")
    activity.run_once(stream, f"{tmp_path}/checkpoint-days", last, "complete")
    expected = activity.activity(batch.withColumn("ts", F.col("ts").cast("timestamp")), "event_type").collect()
    assert days == {(r.event_type, r.period): r.n for r in expected}
