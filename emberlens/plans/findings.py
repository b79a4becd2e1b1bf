"""Findings, artifacts and captures on built-in rows and on the driver's tables."""

import json

from pyspark.sql import functions as F

from ..operators import artifacts, ci, findings, profiles, traces
from ..sources import har
from .registry import case, query, values

FOUND = [("s", "1", "a", "A", "high", "b.py", 3, "Slow loop"), ("s", "2", "b", "A", "low", "a.py", 1, "slow read"), ("s", "3", "a", "B", "high", "a.py", 9, "idle"), ("s", "4", "a", "B", "high", "a.py", 2, "idle"), ("s", "5", "b", "B", "medium", None, None, "other")]
COLUMNS = "scan string, id string, owner string, check_id string, confidence string, file string, line int, summary string"


def _found(t):
    return t.spark.createDataFrame(FOUND, COLUMNS)


@case(values([("1", 1), ("4", 2), ("3", 3), ("5", 4), ("2", 5)], ["id", "place"]))
def findings_order(t):
    """Findings by confidence, check, file, line and id."""
    return findings.in_order(_found(t)).select("id", "place")


@case(values([("1", 0, None), ("3", 0, None), ("4", 0, None), ("5", 0, None), (None, 1, "A")], ["id", "hidden", "check_id"]))
def findings_surface(t):
    """Findings over the floor of their check, and the count of those under it."""
    kept, hidden = findings.surfaced(_found(t), {"A": "medium"})
    return kept.select("id", F.lit(0).alias("hidden"), F.lit(None).cast("string").alias("check_id")).unionByName(hidden.select(F.lit(None).cast("string").alias("id"), "hidden", "check_id"))


@case(values([("1",), ("2",)], ["id"]))
def findings_filter(t):
    """Findings whose text holds a word in any case."""
    return findings.filtered(_found(t), text="SLOW").select("id")


@query("SELECT o_orderpriority AS check_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY o_orderpriority")
def findings_per_check(t):
    """Findings by check, most first and then by name: orders by priority."""
    from pyspark.sql import Window

    counts = t.orders.groupBy(F.col("o_orderpriority").alias("check_id")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "check_id")))


@query("SELECT user_id, event_id, ts, n, total - least(total, 5) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE n <= 5")
def recent_of_each(t):
    """The five newest rows of each user, and how many more there are."""
    return findings.first_of_each(t.events, ["user_id"], [F.desc("ts"), F.col("event_id")], 5).select("user_id", "event_id", "ts", "n", "omitted")


@query("SELECT * FROM orders WHERE o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '_-LOW'")
def allowlist(t):
    """Rows whose name fits a glob of a list."""
    return findings.allowed(t.orders, F.col("o_orderpriority"), ["1-*", "?-LOW"])


@case(values([("a", "result", None), ("b", "error", None), ("c", "error", "has 2 of four states"), ("d", "error", "has 0 of four states"), ("e", "not_applicable", None)], ["check_id", "grade", "problem"]))
def check_grades(t):
    """A check is in exactly one of four states."""
    rows = [("a", None, None, None, "r"), ("b", "e", None, None, None), ("c", "e", None, None, "r"), ("d", None, None, None, None), ("e", None, None, "n", None)]
    return findings.graded(t.spark.createDataFrame(rows, "check_id string, error string, unavailable string, not_applicable string, result string"))


@case(values([("1", "b.py", 7), ("2", None, None)], ["id", "file", "line"]))
def primary_locations(t):
    """The first static evidence of a finding is its place."""
    found = t.spark.createDataFrame([("1",), ("2",)], "id string")
    evidence = t.spark.createDataFrame([("1", 0, "data", "m", None), ("1", 1, "static", "b.py", 7), ("1", 2, "static", "a.py", 1), ("2", 0, "data", "m", None)], "id string, n int, kind string, locator string, line int")
    return findings.primary_location(found, evidence)


@case(values([("s1", "other lines"), ("s9", "no such source"), ("s2", "other value"), ("s1", "other scope")], ["source_id", "reason"]))
def evidence_rejects(t):
    """Evidence that its source does not bear out."""
    sources = t.spark.createDataFrame([("s1", "x", "static", "a.py", "one\ntwo\nthree"), ("s2", "x", "data", "m", "5")], "source_id string, scope string, kind string, locator string, content string")
    rows = [("s1", "x", "static", "a.py", 2, "two\nthree"), ("s1", "x", "static", "a.py", 1, "two"), ("s9", "x", "static", "a.py", 1, "one"), ("s2", "x", "data", "m", None, "6"), ("s2", "x", "data", "m", None, "5"), ("s1", "y", "static", "a.py", 1, "one")]
    return findings.unsupported(t.spark.createDataFrame(rows, "source_id string, scope string, kind string, locator string, line int, value string"), sources).select("source_id", "reason")


@case(values([("1", "step", "a", "s1"), ("2", "job", "a", None), ("3", "workflow", None, None), ("4", "none", None, None), ("5", "job", "b", None)], ["id", "level", "job", "step"]))
def finding_links(t):
    """Findings linked to the one job and step whose lines hold them."""
    found = t.spark.createDataFrame([("1", "w.yml", 5), ("2", "w.yml", 8), ("3", "w.yml", 40), ("4", "x.py", 1), ("5", "w.yml", 21)], "id string, file string, line int")
    jobs = t.spark.createDataFrame([("w.yml", "a", 3, 10), ("w.yml", "b", 20, 30)], "file string, job string, first int, last int")
    steps = t.spark.createDataFrame([("w.yml", "a", "s1", 4, 6), ("w.yml", "b", "s2", 21, 22), ("w.yml", "b", "s3", 21, 25)], "file string, job string, step string, first int, last int")
    return findings.linked(found, jobs, steps).select("id", "level", "job", "step")


@query("WITH d AS (SELECT *, greatest(value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id), 0) AS step FROM events) SELECT user_id AS pid, event_type AS created, round(coalesce(sum(step), 0), 4) AS joules, count(*) AS samples FROM d GROUP BY ALL")
def energy_deltas(t):
    """Energy from running counters, whose falls add nothing: a user's events as samples."""
    samples = t.events.select(F.col("user_id").alias("pid"), F.col("event_type").alias("created"), F.col("event_id").alias("at"), F.col("value").alias("energy"))
    return findings.energy_used(samples).withColumn("joules", F.round("joules", 4))


@case(values([("net", 0.5, "detected"), ("noisy", 0.1, "clean"), ("few", 0.5, "omitted"), ("moved", 0.5, "omitted"), ("slow", 0.5, "clean")], ["case", "improvement", "status"]))
def net08_benchmark(t):
    """NET-08 and NET-10: a gain counts beyond the noise, on one machine, without a cost in CPU."""
    rows = []
    for case, a, b, cpu, n, places in (("net", [10, 10, 11, 9, 10], [5] * 5, (1.0, 1.0), 5, "x"), ("noisy", [10, 14, 6, 10, 12], [9, 9, 5, 13, 9], (1.0, 1.0), 5, "x"), ("few", [10] * 2, [5] * 2, (1.0, 1.0), 2, "x"), ("moved", [10] * 5, [5] * 5, (1.0, 1.0), 5, "xy"), ("slow", [10] * 5, [5] * 5, (1.0, 2.0), 5, "x")):
        for arm, sizes, used in (("a", a, cpu[0]), ("b", b, cpu[1])):
            rows += [(case, arm, m, float(v), places[0] if arm == "a" else places[-1]) for k in range(n) for m, v in (("bytes", sizes[k]), ("cpu", used))]
    samples = t.spark.createDataFrame(rows, "case string, arm string, metric string, value double, machine string")
    out = artifacts.compared(samples, "case", "arm", "metric", "value", "machine", "bytes", "cpu", 0.05, 0.1)
    return out.select("case", F.round("improvement", 6).alias("improvement"), "status")


@query("WITH m AS (SELECT l_shipdate >= TIMESTAMP '1995-01-01' AS late, median(l_extendedprice) AS median, count(*) AS samples FROM lineitem GROUP BY ALL) SELECT late, median, samples, (SELECT median(abs(l_extendedprice - m.median)) FROM lineitem l WHERE (l.l_shipdate >= TIMESTAMP '1995-01-01') = m.late) AS mad FROM m")
def median_spread(t):
    """Median and median absolute deviation of prices."""
    return artifacts.median_and_spread(t.lineitem.select((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).alias("late"), "l_extendedprice"), ["late"], "l_extendedprice")


@case(values([("a", "preemptions", "detected"), ("a", "length reserved", "detected"), ("b", None, "clean"), ("c", None, "omitted")], ["server_id", "rule", "status"]))
def llm19_engines(t):
    """LLM-19: counters of model servers."""
    rows = [("a", 1000, 20, 0.5, 0.5, 9000, 1000), ("b", 1000, 10, 0.95, 0.05, 4000, 1000), ("c", 99, 90, 1.0, 0.0, 9000, 1)]
    return artifacts.engine_metrics(t.spark.createDataFrame(rows, "server_id string, requests long, preemptions long, kv_cache_usage_max double, prefix_cache_hit_rate double, max_model_len long, max_request_tokens long"))


@case(values([("a", "network_call_count,setup_seconds", "high"), ("b", "duration_seconds", "medium")], ["test_id", "fields", "confidence"]))
def tst12_artifacts(t):
    """TST-12: measured tests over their limits."""
    rows = [("a", 0.5, 0.0, 3, 10, 2.0), ("b", 9.0, 0.0, 0, 10, 0.1), ("c", 0.5, 0.0, 0, 10, 0.1)]
    tests = t.spark.createDataFrame(rows, "test_id string, duration_seconds double, sleep_seconds double, network_call_count int, fixture_bytes int, setup_seconds double")
    return artifacts.slow_tests(tests, {"duration_seconds": 5, "sleep_seconds": 0, "network_call_count": 0, "fixture_bytes": 1000, "setup_seconds": 1})


@case(values([("FE-11", "p", "a.js", 50.0, "detected"), ("FE-13", "p", "a.js", 10239.0, "clean"), ("FE-15", "p", "b.js", 31.0, "detected"), ("FE-02", "p", "i", 1.0, "detected")], ["check_id", "page", "resource", "value", "status"]))
def page_audits(t):
    """FE-02, 10, 11, 13 and 15: audit fields against their limits, summed by resource."""
    rows = [("p", "a.js", "unminified_ms", 50.0), ("p", "a.js", "unused_bytes", 10239.0), ("p", "b.js", "reflow_ms", 20.0), ("p", "b.js", "reflow_ms", 11.0), ("p", "i", "lazy_lcp", 1.0), ("p", "i", "other", 9.0)]
    return artifacts.page_fields(t.spark.createDataFrame(rows, "page string, resource string, field string, value double"))


@case(values([("http://h/app/a.js", "web/app/a.js"), ("http://h/x/c.js", "x/c.js")], ["url", "file"]))
def url_files(t):
    """URLs of repository files, where only one file fits."""
    urls = t.spark.createDataFrame([("http://h/app/a.js", "/app/a.js"), ("http://h/b.js", "/b.js"), ("http://h/x/c.js", "/srv/x/c.js")], "url string, path string")
    files = t.spark.createDataFrame([("web/app/a.js",), ("one/b.js",), ("two/b.js",), ("x/c.js",), ("y/c.js",)], "path string")
    return artifacts.unique_suffix(urls, files)


@case(values([("a.js", 3, "detected"), ("a.js", 9, "clean"), ("b.js", 1, "omitted")], ["path", "line", "status"]))
def js_confirmed(t):
    """JS-02 to JS-08: candidates that a profile finds heavy."""
    found = t.spark.createDataFrame([("a.js", 3), ("a.js", 9), ("b.js", 1)], "path string, line int")
    return artifacts.confirmed(found, t.spark.createDataFrame([("a.js", 3, 0.2), ("a.js", 9, 0.01)], "path string, line int, share double"), 0.1).select("path", "line", "status")


READS = [("r", "t", 1, "x", "q1", False), ("r", "t", 3, "x", "q2", True), ("r", "u", 2, "x", "q3", False), ("r", "t", 2, "y", "q4", True)]
READ = "request string, transaction string, n int, variable string, query string, used boolean"


@case(values([("r", "t", "x", 1, 3)], ["request", "transaction", "variable", "n", "next"]))
def db05_dead_stores(t):
    """DB-05: a result that the same transaction reads again before any use."""
    return artifacts.dead_store_queries(t.spark.createDataFrame(READS, READ))


@case(values([("r", "u", "x", 2, "q3")], ["request", "transaction", "variable", "n", "query"]))
def db16_unused(t):
    """DB-16: a read that nothing uses."""
    return artifacts.unused_queries(t.spark.createDataFrame(READS, READ))


@case(values([("false", "detected"), ("null", "detected"), ("either", "clean"), ("column", "clean"), ("is null", "detected")], ["query", "status"]))
def db06_known_empty(t):
    """DB-06: predicates that are false or unknown for every row."""
    rows = [("false", 0, "1", "=", "2", False), ("null", 0, "1", "<>", None, False), ("either", 0, "1", "=", "2", False), ("either", 1, "1", "=", "1", False), ("column", 0, "a", "=", "2", True), ("column", 0, "1", "=", "1", False), ("is null", 0, "a", "=", None, True)]
    return artifacts.known_empty(t.spark.createDataFrame(rows, 'query string, branch int, left string, op string, right string, is_column boolean'))


@case(values([("f", 1, 2)], ["function", "build", "guard"]))
def db34_late_guards(t):
    """DB-34: SQL built before the cache is asked."""
    return artifacts.late_guards(t.spark.createDataFrame([("f", 1, "build"), ("f", 2, "guard"), ("f", 3, "run"), ("g", 1, "guard"), ("g", 2, "build"), ("g", 3, "run")], "function string, n int, kind string"))


@case(values([("f", "http")], ["function", "client"]))
def net04_clients(t):
    """NET-04: a client made in each request."""
    rows = [("f", True, "http", "construct"), ("f", True, "http", "use"), ("f", True, "db", "use"), ("g", False, "http", "construct"), ("g", False, "http", "use")]
    return artifacts.clients_per_request(t.spark.createDataFrame(rows, "function string, handler boolean, client string, kind string"))


def _entry(url):
    return {"startedDateTime": "2024-01-01T00:00:00Z", "time": 5.0, "request": {"method": "GET", "url": url, "headers": [{"name": "Cookie", "value": "x"}]}, "response": {"status": 200, "content": {"size": 9, "mimeType": "text/html"}}}


CAPTURES = [("a", ["http://h/x?q=1", "http://h/y"], 2), ("b", ["http://h/x"], 2), ("c", ["http://h/x?token=1"], 1), ("d", ["http://me:pw@h/x"], 1)]


def _captures(t):
    rows = [(c, json.dumps({"log": {"entries": [_entry(u) for u in urls]}}), json.dumps([{"operation": f"o{k}", "request_group": "g"} for k in range(n)])) for c, urls, n in CAPTURES] + [("e", "{", "[]")]
    return har.requests(t.spark.createDataFrame(rows, "capture string, har string, sidecar string"))


@case(values([("a", 0, "GET", "http://h/x", 200, 9, 5.0, "o0", "g"), ("a", 1, "GET", "http://h/y", 200, 9, 5.0, "o1", "g")], ["capture", "n", "method", "url", "status", "n_bytes", "millis", "operation", "request_group"]))
def har_requests(t):
    """Requests of captures, joined to the sidecar by place."""
    return _captures(t)[0]


@case(values([("b", "sidecar does not match"), ("c", "credentials in a URL"), ("d", "credentials in a URL"), ("e", "no entries")], ["capture", "reason"]))
def har_refused(t):
    """Captures that are not read."""
    return _captures(t)[1]


@case(values([("known", 3, 2, 2, 30.0), ("unknown", 2, 2, 2, None), ("seldom", 2, 2, 1, 20.0), ("none", 1, 0, 0, 0.0)], ["workflow", "runs", "executed", "sampled", "estimate"]))
def ci_impact_unknown(t):
    """A sampled run on unknown hardware makes its workflow unknown; one that was not sampled does not."""
    rows = [("known", True, True, 10.0), ("known", True, True, 20.0), ("known", False, False, None), ("unknown", True, True, 10.0), ("unknown", True, True, None), ("seldom", True, True, 10.0), ("seldom", True, False, None), ("none", False, False, None)]
    runs = t.spark.createDataFrame(rows, "workflow string, executed boolean, sampled boolean, wh double")
    return ci.impact_summary(runs, "workflow", F.col("executed"), "wh", F.col("sampled"))


@case(values([("main", "clean"), ("hub", "detected"), ("pass", "clean"), ("a", "detected"), ("b", "detected"), ("c", "detected")], ["function", "status"]))
def obs19_callees(t):
    """OBS-19: a function that passes its weight on to one callee is no hot spot."""
    rows = [("p", ["main", "hub", "a"], 300.0), ("p", ["main", "hub", "b"], 300.0), ("p", ["main", "x", "c"], 200.0), ("p", ["main", "y"], 200.0), ("p", ["main", "pass", "hub", "a"], 200.0)]
    out = profiles.hotspots(t.spark.createDataFrame(rows, "profile string, frames array<string>, weight double"), "profile", "frames", "weight", min_inclusive=0.16, most_callee=0.7)
    return out.where("function NOT IN ('x', 'y')").select("function", "status")


@case(values([("t", "1", "1", False), ("t", "2", "1", False), ("u", "1", None, True), ("u", "2", None, True), ("u", "3", None, True)], ["trace_id", "span_id", "owner", "cycle"]))
def span_cycles(t):
    """Spans whose parents run in a circle have no owner."""
    spans = t.spark.createDataFrame([("t", "1", None, True), ("t", "2", "1", False), ("u", "1", "2", False), ("u", "2", "1", False), ("u", "3", "2", False)], "trace_id string, span_id string, parent_id string, wanted boolean")
    return traces.nearest_ancestor(spans, F.col("wanted")).select("trace_id", "span_id", "owner", "cycle")


@case(values([("build", "test", 2, 25.0, "detected")], ["job_a", "job_b", "runs", "median_seconds", "status"]))
def ci18_needs(t):
    """CI-18 along the edges that a workflow states."""
    jobs = t.spark.createDataFrame([(1, "build", 0, 10), (1, "test", 12, 25), (1, "lint", 11, 12), (2, "build", 0, 10), (2, "test", 10, 25), (3, "build", 0, 10), (3, "test", 90, 95)], "run int, job string, a int, b int")
    return ci.chains(jobs, "run", "job", "a", "b", 60, 20, needs=t.spark.createDataFrame([("build", "test")], "job_a string, job_b string"))
