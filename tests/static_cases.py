"""Static rules on built-in files, one query for each rule; expected rows stand in the files or beside them.

A line of a Python file that ends in ``# hit: X`` is one that rule X must find; no other line may be found.
"""

import json
import re

from pyspark.sql import functions as F

from emberlens.operators import static_config, static_python, static_web
from emberlens.plans.registry import case, values
from emberlens.sources import files as file_source
from emberlens.sources import profiles, schedules


def table(t, rows):
    return t.spark.createDataFrame(list(rows), "path string, text string")


PYTHON = {
    "app/flow.py": """import json
import os  # hit: CODE-C1.1
import pandas  # hit: CODE-C1.1, PY-10
import re
import time


def flow(items, cache={}):  # hit: CODE-C6.7, PY-09
    total = compute()  # hit: CODE-C1.2
    total = len(items)
    start = 0  # hit: CODE-C1.6
    if total:
        start = 1
    else:
        start = 2
    kept = 5
    print(kept)
    kept = kept  # hit: CODE-C1.2
    same = items
    same = same + [1]
    if total > start:  # hit: CODE-C1.3
        time.sleep(1)
    else:
        time.sleep(1)
    return total
    print(start)  # hit: CODE-C1.1


def loops(items, names, log, frame):
    out = ""
    for i in range(len(items)):  # hit: CODE-C3.1
        pattern = re.compile("a+")  # hit: CODE-C3.3
        out += "x"  # hit: CODE-C10.4, PY-04
        log.info("row")  # hit: OBS-03
        if items[i] in ("a", "b", "c", "d", "e", "f", "g", "h", "i"):  # hit: CODE-C5.1
            print(pattern)
    while names:
        names.pop(0)  # hit: CODE-C3.7, PY-02
    for row in frame.iterrows():  # hit: PY-03
        print(row)
    for n in items:
        print(len(names), max(out))  # hit: CODE-C3.2
        out = n
    found = False
    for n in items:  # hit: CODE-C3.5
        if n == 3:
            found = True
    for n in items:
        if n == 4:
            found = True
            break
    first = sorted(items)[0]  # hit: CODE-C3.6
    some = any([x > 1 for x in items])  # hit: CODE-C3.6
    few = any(x > 1 for x in items)
    log.debug(f"{first} {some} {few} {found}")  # hit: OBS-02
    return json.dumps(out)


def handles(path):
    with open(path) as f:
        f.read()
    return open(path).read()  # hit: CODE-C6.6, PY-08


def whole(session, User):
    session.query(User).limit(5).all()
    User.objects.all()[:10]
    return session.query(User).all()  # hit: DB-23
""",
    "app/remote.py": """import asyncio
import functools
import sqlite3

import requests
import structlog


async def slow(loop):
    requests.patch("http://x")  # hit: CODE-C11.4, PY-07
    sqlite3.connect("x")  # hit: DB-41, CODE-C11.4, PY-07
    await asyncio.to_thread(len, [1])  # hit: CODE-RT.2
    await asyncio.to_thread(work, [1])
    await loop.run_in_executor(None, lambda: 5)  # hit: CODE-RT.2


def rows(db, ids):
    for i in ids:
        db.execute("SELECT a FROM t WHERE id = ?", (i,))  # hit: DB-09
        db.execute("INSERT INTO t VALUES (1)")  # hit: DB-13
    db.execute("SELECT * FROM t")  # hit: DB-14
    db.execute("SELECT count(*) FROM t")
    db.execute("SELECT a FROM t LIMIT 5 OFFSET 500")  # hit: DB-39
    db.execute("SELECT a FROM t LIMIT 5 OFFSET 50")


def ask(client, text):
    client.messages.create(model="m", messages=text)  # hit: LLM-07
    client.messages.create(model="vendor-opus-1", max_tokens=64, messages=text)  # hit: LLM-08
    client.messages.create(model="vendor-mini", max_tokens=64, messages=text)
    for x in text:
        client.messages.create(model="m", max_tokens=9, messages=x)  # hit: LLM-11
    tools = [1]
    client.messages.create(model="m", max_tokens=9, messages=text, tools=[1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21])  # hit: LLM-15
    return tools, structlog.get_logger()


@functools.lru_cache
def answer(client, text):  # hit: LLM-13
    return client.messages.create(model="m", max_tokens=9, messages=text).usage


def chat(client, ask_user):
    history, short = [], []
    while True:
        history.append(ask_user())
        short.append(ask_user())
        client.messages.create(model="m", max_tokens=9, messages=history)  # hit: LLM-14, LLM-11
        client.messages.create(model="m", max_tokens=9, messages=short)  # hit: LLM-11
        short = short[-4:]


def lambda_handler(event, client):
    client.messages.create(model="m", max_tokens=900, stream=True, messages=event)
    return client.messages.create(model="m", max_tokens=900, messages=event)  # hit: LLM-16
""",
    "tests/test_app.py": """import time

from app.flow import flow, loops
from app.remote import ask, chat, rows, slow


def test_two():  # hit: TST-01, TST-02
    assert flow([1])
    assert flow([2])


def test_again():
    assert flow([3]) == 42, "a value"  # hit: TST-04


def test_none():  # hit: TST-06
    loops([], [], None, None)


def test_many(client):  # hit: TST-03
    time.sleep(1)  # hit: TST-12
    ask(client, "")
    chat(client, "")
    rows(client, "")
    slow(client)
    loops([], [], None, None)
    for x in (1, 2):
        assert x, "in a loop"  # hit: TST-09


def test_texts():
    assert str(ask(1, 2)) == "a", "text"  # hit: TST-08
    assert True, "always"  # hit: TST-10


def test_twice():  # hit: TST-01
    assert rows(1, 2)  # hit: TST-05
    assert rows(1, 2)


class TestStore:
    def setUp(self):
        self.db = 1
        self.box = 2  # hit: TST-11

    def test_db(self):
        assert self.db, "a"

    def test_both(self):
        assert self.db + self.box, "b"
""",
    "app/broken.py": "def (\n",
}
#: Rules whose evidence another file takes away have files of their own.
ALONE = {
    "OBS-04": {"a.py": "import logging\n\nlog = logging.getLogger()\nlog.info('x')  # hit: OBS-04\nlog.info('y')\n", "b.py": "print(1)\n"},
    "LLM-09": {"a.py": "def ask(client, t):\n    return client.messages.create(model='m', max_tokens=9, messages=t)  # hit: LLM-09\n"},
    "TST-07": {"tests/test_long.py": "def test_long():  # hit: TST-07\n" + "    step()\n" * 30 + "    assert 1 == one(), 'm'\n"},
    "TST-10": {"tests/test_same.py": "def test_same(self):\n    self.assertEqual(one(), one())  # hit: TST-10\n    self.assertEqual(one(), two())\n"},
}


def marked(files, check):
    """(check, file, line) of the lines that say so."""
    return [(check, path, n) for path, text in files.items() for n, line in enumerate(text.split("\n"), 1) if re.search(rf"# hit: .*\b{re.escape(check)}(,|$)", line)]


def python_query(check, files):
    def run(t):
        found = static_python.hits(static_python.facts(table(t, files.items())))
        return found.where(F.col("check_id") == check).select("check_id", "file", "line").distinct()

    run.__name__, run.__doc__ = "static_" + check.lower().replace("-", "_").replace(".", "_"), f"{check} on built-in Python files."
    case(values(marked(files, check), ["check_id", "file", "line"]))(run)


IN_ALL = sorted({c for text in PYTHON.values() for line in text.split("\n") if "# hit: " in line for c in re.split(", *", line.split("# hit: ")[1])} - set(ALONE))
for _check in IN_ALL:
    python_query(_check, PYTHON)
for _check, _files in ALONE.items():
    python_query(_check, _files)


@case(values([("app/broken.py", "omitted", "does not parse"), ("app/flow.py", "evaluated", None), ("app/remote.py", "evaluated", None), ("tests/test_app.py", "evaluated", None)], ["file", "status", "reason"]))
def static_python_coverage(t):
    """A file that does not parse is omitted, not clean."""
    return static_python.coverage(static_python.facts(table(t, PYTHON.items())))


@case(values([("CODE-C3.6", "a.py", 1), ("CODE-C6.7", "a.py", 3)], ["check_id", "file", "line"]))
def static_noqa(t):
    """Suppressed lines: a bare mark hides all checks of its line, codes hide their own."""
    text = "x = sorted(y)[0]\nx = sorted(y)[0]  # noqa\ndef f(a=[]):  # noqa: CODE-C3.6, PY-09\n    return a\nz = sorted(y)[0]  # NOQA: code-c3.6\n"
    files = table(t, [("a.py", text)])
    return static_python.suppressed(static_python.hits(static_python.facts(files)).select("check_id", "file", "line"), files)


@case(values([("DB-29", "a.py", 2, "left-join:bb")], ["check_id", "file", "line", "identity"]))
def static_db_29(t):
    """DB-29: a LEFT JOIN whose alias nothing else names."""
    text = "def f(db):\n    db.execute('SELECT a.id FROM a LEFT JOIN b AS bb ON bb.id = a.id WHERE a.x = 1')\n    db.execute('SELECT a.id, c.n FROM a LEFT JOIN c c ON c.id = a.id')\n"
    return static_python.unused_left_joins(static_python.facts(table(t, [("a.py", text)]))).select("check_id", "file", "line", "identity")


def workflow(on, jobs):
    return json.dumps({"on": on, "jobs": jobs})


def pod(containers, **more):
    return {"kind": "Deployment", "metadata": {"name": "web"}, "spec": {**more, "template": {"spec": {"containers": containers}}}}


W = ".github/workflows/w.yml"
OTLP = {"name": "OTEL_EXPORTER_OTLP_ENDPOINT", "value": "http://c"}
#: check -> rule, files, and (file, scope, identity, confidence) of each hit
CONFIG = {
    "INF-02": (static_config.fixed_replicas, {"a.json": json.dumps(pod([], replicas=3)), "b.json": json.dumps(pod([], replicas=1))}, [("a.json", "default/Deployment/web", "fixed-replicas", "medium")]),
    "INF-04": (static_config.unreferenced, {"t.json": json.dumps({"Resources": {"Jobs": {"Type": "AWS::SQS::Queue"}, "Mail": {"Type": "AWS::SNS::Topic"}, "Use": {"Type": "AWS::IAM::Policy", "Properties": {"Queue": {"Ref": "Jobs"}}}}})}, [("t.json", "resource:Mail", "unreferenced", "medium")]),
    "INF-06": (static_config.similar_sizes, {"t.json": json.dumps({"Resources": {n: {"Type": "AWS::Serverless::Function", "Properties": {"MemorySize": 512, "Timeout": 9, "Events": {"E": {"Type": e}}}} for n, e in (("A", "Api"), ("B", "SQS"), ("C", "Schedule"))}})}, [("t.json", "t.json", "same-size", "medium")]),
    "INF-07": (static_config.old_instances, {"t.json": json.dumps({"InstanceType": "m4.large", "More": {"InstanceType": "m7g.large"}, "Db": {"DBInstanceClass": "db.t2.small"}})}, [("t.json", "t.json", "/InstanceType", "high"), ("t.json", "t.json", "/Db/DBInstanceClass", "high")]),
    "INF-08": (static_config.unbounded_containers, {"a.json": json.dumps(pod([{"name": "a"}, {"name": "b", "resources": {"limits": {"cpu": 1}}}]))}, [("a.json", "a.json", "container:a", "medium")]),
    "INF-10": (static_config.unmanaged_storage, {"t.json": json.dumps({"Resources": {"Data": {"Type": "AWS::S3::Bucket"}, "Log": {"Type": "AWS::Logs::LogGroup", "Properties": {"RetentionInDays": 5}}}})}, [("t.json", "resource:Data", "LifecycleConfiguration", "medium")]),
    "CI-06": (static_config.uncached_installs, {W: workflow("push", {"a": {"steps": [{"run": "npm ci"}]}, "b": {"steps": [{"uses": "actions/cache@v4"}, {"run": "npm ci"}]}})}, [(W, W, "job:a", "medium")]),
    "CI-07": (static_config.uncached_images, {W: workflow("push", {"a": {"steps": [{"run": "docker build ."}]}, "b": {"steps": [{"run": "docker build --cache-from x ."}]}})}, [(W, W, "job:a", "medium")]),
    "CI-08": (static_config.cleans_after_restore, {W: workflow("push", {"a": {"steps": [{"uses": "actions/cache@v4"}, {"run": "make clean all"}]}, "b": {"steps": [{"run": "make clean"}, {"uses": "actions/cache@v4"}]}})}, [(W, W, "job:a", "high")]),
    "CI-10": (static_config.whole_tests, {W: workflow("pull_request", {"a": {"steps": [{"run": "pytest -q"}]}, "b": {"steps": [{"run": "pytest --lf"}]}}), ".github/workflows/x.yml": workflow({"pull_request": {"paths": ["src/**"]}}, {"a": {"steps": [{"run": "pytest"}]}})}, [(W, W, "job:a", "medium")]),
    "CI-11": (static_config.no_cancellation, {W: workflow("pull_request", {}), ".github/workflows/x.yml": json.dumps({"on": "pull_request", "concurrency": {"group": "g", "cancel-in-progress": True}, "jobs": {}})}, [(W, W, "no-cancellation", "medium")]),
    "CI-13": (static_config.duplicate_axes, {W: workflow("push", {"a": {"strategy": {"matrix": {"py": ["3.12", "3.12"], "os": ["x", "y"]}}}})}, [(W, W, "/jobs/a/strategy/matrix/py", "high")]),
    "CI-14": (static_config.large_runners, {W: workflow("push", {"lint": {"runs-on": "ubuntu-16-cores"}, "test": {"runs-on": "ubuntu-16-cores"}})}, [(W, W, "job:lint", "medium")]),
    "CI-16": (static_config.static_keys, {W: workflow("push", {"a": {"steps": [{"with": {"key": "fixed"}}]}, "b": {"steps": [{"with": {"key": "${{ runner.os }}-${{ hashFiles('x') }}"}}]}})}, [(W, W, "a", "medium")]),
    "CI-19": (static_config.long_retention, {W: workflow("push", {"a": {"steps": [{"with": {"retention-days": 90}}, {"with": {"retention-days": 60}}]}, "b": {"steps": [{"with": {"retention-days": 5}}]}})}, [(W, W, "job:a", "high")]),
    "OBS-01": (static_config.debug_levels, {"conf/prod.json": '{"log_level": "DEBUG"}', "conf/dev.json": '{"log_level": "DEBUG"}', "conf/ok.json": '{"log_level": "INFO"}'}, [("conf/prod.json", "conf/prod.json", "/log_level", "high")]),
    "OBS-05": (static_config.full_sampling, {"c.json": '{"sampling_percentage": 100}', "d.json": '{"sampling_percentage": 10}'}, [("c.json", "c.json", "/sampling_percentage", "medium")]),
    "OBS-08": (static_config.scrape_cost, {"p.json": '{"scrape_interval": "5s", "retention": "30d"}', "q.json": '{"scrape_interval": "5s", "retention": "7d"}'}, [("p.json", "p.json", "/scrape_interval", "medium")]),
    "OBS-09": (static_config.unbatched_exports, {"c.json": json.dumps({"exporters": {"otlp": {"compression": "none"}}, "service": {"pipelines": {"traces": {"processors": ["memory_limiter"]}, "logs": {"processors": ["batch"]}}}})}, [("c.json", "c.json", "/exporters/otlp", "medium"), ("c.json", "c.json", "/service/pipelines/traces", "medium")]),
    "OBS-12": (static_config.default_instrumentation, {"a.json": json.dumps(pod([{"name": "a", "command": ["opentelemetry-instrument", "python"]}, {"name": "b", "command": ["opentelemetry-instrument"], "env": [{"name": "OTEL_PYTHON_DISABLED_INSTRUMENTATIONS", "value": "x"}]}]))}, [("a.json", "a.json", "/spec/template/spec/containers/0", "medium")]),
    "OBS-13": (static_config.traced_probes, {"a.json": json.dumps(pod([{"name": "a", "env": [OTLP], "livenessProbe": {"httpGet": {"path": "/healthz"}, "periodSeconds": 5}, "readinessProbe": {"httpGet": {"path": "/ready"}}}, {"name": "b", "livenessProbe": {"httpGet": {"path": "/live"}}}], replicas=2)), "c.json": json.dumps({"processors": {"filter": {"traces": {"span": ["attributes['http.target'] == '/ready'"]}}}})}, [("a.json", "a.json", "livenessProbe:/healthz:34560", "medium")]),
    "OBS-14": (static_config.paid_telemetry, {"deploy/dev/c.json": '{"exporters": {"otlp": {"endpoint": "https://api.honeycomb.io"}}}', "deploy/prod/c.json": '{"exporters": {"otlp": {"endpoint": "https://api.honeycomb.io"}}}', "deploy/test/c.json": '{"processors": {"filter": {}}, "exporters": {"otlp": {"endpoint": "https://api.honeycomb.io"}}}'}, [("deploy/dev/c.json", "deploy/dev/c.json", "/exporters/otlp/endpoint", "medium")]),
    "LLM-19": (static_config.server_flags, {"a.json": json.dumps(pod([{"name": "s", "args": ["vllm", "serve", "--enforce-eager"]}])), "b.json": json.dumps(pod([{"name": "s", "args": ["serve", "--enforce-eager"]}]))}, [("a.json", "a.json", "--enforce-eager", "medium")]),
}


def config_query(check, rule, files, expected):
    def run(t):
        return rule(static_config.facts(table(t, files.items())))

    run.__name__, run.__doc__ = "static_" + check.lower().replace("-", "_") + ("_config" if check == "LLM-19" else ""), f"{check} on built-in configuration."
    case(values([(check, *row) for row in expected], ["check_id", "file", "scope", "identity", "confidence"]))(run)


for _check, (_rule, _files, _expected) in CONFIG.items():
    config_query(_check, _rule, _files, _expected)


@case(values([("INF-09", "Dockerfile", "Dockerfile", "pip cache kept", "medium"), ("INF-09", "x/Dockerfile", "x/Dockerfile", "apk cache kept", "medium")], ["check_id", "file", "scope", "identity", "confidence"]))
def static_inf_09(t):
    """INF-09: bloat of the stages that ship, not of a stage that only lends files."""
    files = {"Dockerfile": "FROM python:3.13 AS build\nRUN apt-get update && \\\n  apt-get install -y gcc\nFROM python:3.13-slim\nCOPY --from=build /x /x\nRUN pip install flask\n", "x/Dockerfile": "FROM alpine AS base\nRUN apk add curl\nFROM base\nRUN echo 1\n"}
    return static_config.image_bloat(static_config.dockerfiles(table(t, files.items())))


@case(values([("a.json", "evaluated", None), ("b.json", "omitted", "does not parse")], ["file", "status", "reason"]))
def static_config_coverage(t):
    """Configuration that does not parse is omitted."""
    return static_config.coverage(static_config.facts(table(t, [("a.json", "{}"), ("b.json", "{")])))


@case(values([("a.css", "width", 1), ("b.css", "all", 2)], ["path", "property", "declarations"]))
def static_fe_17(t):
    """FE-17: transitions that lay out again."""
    return static_web.layout_transitions(table(t, [("a.css", "a { transition: width 1s, opacity 2s } /* transition: height 1s */"), ("b.css", "a { transition: all 1s } b { transition-property: all; }"), ("c.css", "a { transition: opacity 1s }")]))


@case(values([("a.js", 1, 0, 0, 0), ("c.js", 0, 0, 1, 0)], ["path", "added", "removed", "started", "stopped"]))
def static_js_06(t):
    """JS-06: listeners and timers that nothing ends."""
    return static_web.uncleared(table(t, [("a.js", "el.addEventListener('x', f)\n// removeEventListener("), ("b.js", "el.addEventListener('x', f); el.removeEventListener('x', f)"), ("c.js", "setInterval(f, 5)")]))


@case(values([("a.js", 1)], ["path", "throws"]))
def static_js_09(t):
    """JS-09: a throw that its own try catches."""
    return static_web.local_throws(table(t, [("a.js", "try { throw new Error() } catch (e) {}"), ("b.js", "try { f() } catch (e) { throw e }")]))


@case(values([("p", "logger", "pino,winston")], ["path", "category", "tools"]))
def static_obs_15(t):
    """OBS-15: two tools of one category in a package."""
    names = t.spark.createDataFrame([("p", "winston"), ("p", "pino"), ("p", "pino"), ("q", "pino"), ("q", "other")], "path string, name string")
    return static_web.overlapping_tools(names, {"winston": "logger", "pino": "logger"}).withColumn("tools", F.array_join("tools", ","))


@case(values([("s", "user_id", 3, "user_id", 4)], ["scope", "concept", "spellings", "reference", "uses"]))
def static_obs_18(t):
    """OBS-18: one concept under several spellings; the most used is the reference, snake case on a tie."""
    rows = [("s", "userId", "a"), ("s", "user_id", "a"), ("s", "user_id", "b"), ("s", "user-id", "a"), ("s", "ok", "a"), ("r", "ok", "a")]
    fields = t.spark.createDataFrame(rows, "scope string, key string, file string")
    return static_web.field_drift(fields.withColumn("concept", static_web.concept(F.col("key"))), "scope", "concept", "key", "file")


@case(values([("Dockerfile", "python", "3.8", 6), ("ci.yml", "node", "16", -30)], ["path", "runtime", "version", "days_left"]))
def static_code_rt_6(t):
    """CODE-RT.6: runtimes near or past their end of support, at a stated date."""
    support = t.spark.createDataFrame([("python", "3.8", "2024-10-07"), ("node", "16", "2024-09-01"), ("python", "3.13", "2029-10-01")], "runtime string, version string, ends string").withColumn("ends", F.col("ends").cast("date"))
    files = table(t, [("Dockerfile", "FROM python:3.8-slim"), ("ci.yml", "image: node:16"), ("new", "FROM python:3.13")])
    return static_web.end_of_life(files, support, "2024-10-01").select("path", "runtime", "version", "days_left")


@case(values([("a", "2024-03-30 00:00:00", False), ("a", "2024-03-31 00:00:00", False), ("a", "2024-04-01 00:00:00", False), ("b", "2024-03-30 01:30:00", False), ("b", "2024-04-01 00:30:00", False), ("c", None, True)], ["job_id", "at", "problem"]))
def schedule_occurrences(t):
    """Rates and cron in a zone: a local time that a clock change skips does not occur; a malformed schedule is a row with a problem."""
    import datetime as dt

    rows = [("a", "rate(1 day)", None, None), ("b", "30 2 * * *", "posix", "Europe/Berlin"), ("c", "61 * * * *", "posix", "UTC")]
    frame = t.spark.createDataFrame(rows, "job_id string, expression string, dialect string, timezone string")
    got = schedules.occurrences(frame, dt.datetime(2024, 3, 30, tzinfo=dt.UTC), dt.datetime(2024, 4, 2, tzinfo=dt.UTC))
    return got.select("job_id", F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("problem").isNotNull().alias("problem"))


@case(values([(1, 1.0), (5, 0.75)], ["line", "share"]))
def speedscope_shares(t):
    """Speedscope samples: a frame counts once for each stack."""
    speed = {"shared": {"frames": [{"name": "main", "file": "a.py", "line": 1}, {"name": "f", "file": "a.py", "line": 5}]}, "profiles": [{"type": "sampled", "samples": [[0, 1, 1], [0]], "weights": [3, 1]}]}
    raw = t.spark.createDataFrame([("p", json.dumps(speed))], "profile string, text string")
    return profiles.line_shares(profiles.speedscope(raw, "profile", "text"), "profile").select("line", "share")


@case(values([("(root)", 0, 3), ("a", 0, 3), ("b", 1, 3), ("a2", 2, 2)], ["function", "own", "inclusive"]))
def cpuprofile_shares(t):
    """V8 samples by function, with those of callees; idle time is left out."""
    node = lambda i, name, children: {"id": i, "callFrame": {"functionName": name, "url": "u", "lineNumber": i}, "children": children}
    v8 = {"nodes": [node(1, "(root)", [2, 5]), node(2, "a", [3]), node(3, "b", [4]), node(4, "a2", []), node(5, "(idle)", [])], "samples": [4, 4, 3, 5]}
    got = profiles.cpuprofile(t.spark.createDataFrame([("p", json.dumps(v8))], "profile string, text string"), "profile", "text")
    return got.select("function", F.col("self").alias("own"), "inclusive")


@case(values([("a.py", 3, 70, 0, 100, 7), ("b.py", 9, 0, 4, 100, 7)], ["file", "line", "bytes", "n", "total_bytes", "peak_bytes"]))
def memray_lines(t):
    """memray's largest allocations by line."""
    mem = {"total_num_allocations": 5, "total_bytes_allocated": 100, "top_allocations_by_size": [{"location": "f:a.py:3", "size": 60}, {"location": "f:a.py:3", "size": 10}], "top_allocations_by_count": [{"location": "g:b.py:9", "count": 4}], "metadata": {"peak_memory": 7}}
    got = profiles.memray(t.spark.createDataFrame([("p", json.dumps(mem))], "profile string, text string"), "profile", "text")
    return got.select("file", "line", "bytes", "n", "total_bytes", "peak_bytes")


TREE = [("a.py", b"x"), (".tox/b.py", b"x"), ("third_party/c.py", b"x"), ("yarn.lock", b"x"), ("go.sum", b"x"), ("m.min.js", b"x"), ("m.js.map", b"x"), ("big.txt", b"x" * 50), ("bin.dat", b"a\x00b"), ("raw.txt", b"\xff\xfe"), ("z.py", b"y")]


@case(values([("excluded folder", 2), ("lock file", 1), ("minified", 2), ("too large", 1), ("binary", 1), ("not UTF-8", 1), ("beyond the scan's bounds", 1)], ["reason", "n"]))
def scan_skips(t):
    """What a scan of a tree leaves out, by reason."""
    rows = t.spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in TREE], "path string, n_bytes long, content binary")
    return file_source.scan(rows, file_source.Limits(files=2, file_bytes=20))[1]


@case(values([("a.py", 1, "x"), ("go.sum", 1, "x")], ["path", "n_bytes", "text"]))
def scan_files(t):
    """What a scan of the same tree reads, in path order up to its bound."""
    rows = t.spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in TREE], "path string, n_bytes long, content binary")
    return file_source.scan(rows, file_source.Limits(files=2, file_bytes=20))[0]
