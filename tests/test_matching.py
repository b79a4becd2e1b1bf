"""Canonical values, pairs, suffixes, grams, order statistics and intervals against plain Python."""

import json
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlens.functions.canonical import canonical_field, canonical_json, canonical_text, lines_of
from emberlens.operators import containment, grams, pairs, quantiles, suffixes


def test_canonical_json(spark):
    cases = ['{"b":1,"a":[1.50,1e2,-0.0,1E400]}', '{"b": {"d": null, "c": "é\\u00e9\\n"}, "a": [true, 1.50, 1e2]}', "[]", '"x"', "3", "3.0", "NaN", '{"a": Infinity}', "", "{", None, '{"a":1,"a":2}', '"\\ud800"', '"\\ud83d\\ude00"', "[" * 100000, "12345678901234567890123", '{"10":1,"9":2,"é":3,"z":4,"\U0001f600":5,"":6}']
    got = [r.c for r in spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, x string").orderBy("k").select(canonical_json(F.col("x")).alias("c")).collect()]
    assert got == [canonical_text(x) for x in cases]
    want = {1: '{"a":[true,1.5,100.0],"b":{"c":"éé\\n","d":null}}', 2: "[]", 3: '"x"', 4: "3", 5: "3.0", 6: None, 7: None, 8: None, 9: None, 10: None, 11: '{"a":2}', 12: None, 13: '"\U0001f600"', 14: None, 15: "12345678901234567890123"}
    assert {k: got[k] for k in want} == want and got[0] is None and list(json.loads(got[16])) == sorted(json.loads(cases[16]))
    fields = spark.createDataFrame([('{"a":{"c":1, "b":2}}', "a"), ('{"a":1}', "b"), ("[1]", "a"), (None, "a"), ('{"a":null}', "a"), ('{"a\'b": "x"}', "a'b")], "d string, f string")
    assert [r.v for r in fields.select(canonical_field(F.col("d"), F.col("f")).alias("v")).collect()] == ['{"b":2,"c":1}', None, None, None, "null", '"x"']


def test_lines_are_as_the_contract_counts_them(spark):
    rng = random.Random(1)
    texts = ["", "\n", "a", "a\n", "a\n\n", "\r\n\r", "a\rb\r\nc\x85d e f\x0bg\x0ch\x1ci\x1dj\x1ek\x1fl"] + ["".join(rng.choice("ab\n\r\x0b\x85  ") for _ in range(12)) for _ in range(60)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(lines_of(F.col("t")).alias("l")).collect()
    assert [r.l for r in rows] == [t.splitlines() for t in texts]


def test_evidence_is_held_against_its_source(spark):
    sources = [("r", "s", "x", "a.py", "static", "one\r\ntwo\x0bthree", None), ("r", "d", "x", "m", "data", None, '{"n": {"b": 1, "a": 2.0}, "z": null}'), ("q", "s", "x", "a.py", "static", "", None)]
    cases = [
        ("r", 1, "s", "x", "a.py", "static", 2, None, "two\nthree", None), ("r", 2, "s", "x", "a.py", "static", 3, None, "three\n", None), ("r", 3, "s", "x", "a.py", "static", 3, None, "three\nfour", "source lines"),
        ("r", 4, "s", "x", "a.py", "static", 1, None, "", "source lines"), ("r", 5, "s", "x", "a.py", "static", 0, None, "one", "source lines"), ("r", 6, "s", "x", "a.py", "static", None, None, "one", "source lines"), ("r", 7, "s", "x", "a.py", "static", 1, None, None, "source lines"),
        ("r", 8, "s", "y", "a.py", "static", 1, None, "one", "different scope"), ("r", 9, "s", "x", "b.py", "static", 1, None, "one", "locator or kind"), ("r", 10, "s", "x", "a.py", "data", 1, "n", "one", "locator or kind"), ("r", 11, "t", "x", "a.py", "static", 1, None, "one", "unknown source"),
        ("q", 12, "d", "x", "m", "data", None, "n", "1", "unknown source"), ("r", 13, "d", "x", "m", "data", None, "n", '{"a":2.0,  "b":1}', None), ("r", 14, "d", "x", "m", "data", None, "n", '{"a":2,"b":1}', "data field"), ("r", 15, "d", "x", "m", "data", None, "z", "null", None),
        ("r", 16, "d", "x", "m", "data", None, "y", "null", "data field"), ("q", 17, "s", "x", "a.py", "static", 1, None, "x", "source lines"), ("r", 18, "d", "x", "m", "data", None, "n", "no json", "data field"),
    ]
    s = spark.createDataFrame(sources, "k string, source_id string, scope_id string, locator string, kind string, content string, data string")
    e = spark.createDataFrame([c[:-1] for c in cases], "k string, n int, source_id string, scope_id string, locator string, kind string, line int, field string, value string")
    assert {r.n: r.reason for r in pairs.rejected_evidence(e, s, "k").collect()} == {c[1]: c[-1] for c in cases if c[-1]}
    done = spark.createDataFrame([("r", "x"), ("r", "w"), ("q", "x")], "k string, scope_id string")
    assert [tuple(r) for r in pairs.unsupplied(done, s, "k").collect()] == [("r", "w")]
    used = spark.createDataFrame([("r", "m", "s"), ("r", "m", "t"), ("q", "n", "s")], "k string, measurement string, source_id string")
    assert [(r.source_id, r.reason) for r in pairs.unproven(used, s, done.where("k = 'r'"), "k").collect() if r.k == "r"] == [("t", "unknown source")]
    assert [(r.k, r.reason) for r in pairs.unproven(used, s, done.where("k = 'r'"), "k").collect() if r.k == "q"] == [("q", "scope not evaluated")]


def test_identity_of_eight_fields(spark):
    base = {"schema_version": "1", "repository_id": "r", "scan_id": "s", "commit_sha": None, "check_id": "c", "detector_version": "2", "context": '{"a":1,"b":[2]}', "scope": '["x"]'}
    changed = {"k0": {}, "k1": {"context": '{ "b":[2], "a":1}'}, "k2": {"context": '{"a":1.0,"b":[2]}'}, "k3": {"scope": '["x","y"]', "scan_id": None}, "k4": {"context": "no json"}}
    names = list(base)
    schema = "k string, " + ", ".join(f"{n} string" for n in names)
    inputs = spark.createDataFrame([(k, *base.values()) for k in changed], schema)
    results = spark.createDataFrame([(k, *(base | c).values()) for k, c in changed.items()] + [("k9", *base.values())], schema)
    assert {r.k: r.fields for r in pairs.same_identity(inputs, results, "k").collect()} == {"k2": "context", "k3": "scan_id,scope", "k4": "context", "k9": "no input"}


def test_suffixes_mean_one_file_or_none(spark):
    rng = random.Random(2)
    name = lambda: "/".join(rng.choice("ab") + rng.choice(("", ".js")) for _ in range(rng.randrange(1, 5)))
    files = {name() for _ in range(40)} | {f"d{k}/index.js" for k in range(300)} | {"x/y/z.css"}
    paths = sorted({name() for _ in range(120)} | {"index.js", "d7/index.js", "q/d7/index.js", "x/y/z.css", "y/z.css", "yy/z.css", "p/x/y/z.css", "", "/a"})
    want = {}
    for p in paths:
        fits = [f for f in files if p and (f == p or f.endswith("/" + p) or p.endswith("/" + f))]
        want[p] = (len(fits), fits[0] if len(fits) == 1 else None)
    frame = spark.createDataFrame([(p, 1) for p in paths], "p string, _f int")
    rows = suffixes.unique_files(frame, "p", spark.createDataFrame([(f,) for f in [*files, *sorted(files)[:5], ""]], "f string"), "f").collect()
    assert {r.p: (r.fits, r.file) for r in rows} == want and want["index.js"] == (300, None) and want["y/z.css"] == (1, "x/y/z.css")
    urls = ["https://h.example/a/b.js?x=/y#z", "http://h/", "file:///srv/p/x/y/z.css", "https://h/x/y/z.css;v=1", "/rel/q", "//h/z", "https://h?q=/a"]
    got = {r.u: r.scope_key for r in suffixes.scope_keys(spark.createDataFrame([(u,) for u in [*urls, urls[0]]], "u string"), "u", spark.createDataFrame([("x/y/z.css",)], "f string"), "f").collect()}
    assert got == {urls[0]: "page:/a/b.js", urls[1]: "page:/", urls[2]: "x/y/z.css", urls[3]: "x/y/z.css", urls[4]: "page:/rel/q", urls[5]: "page:/z", urls[6]: "page:/"}


def test_least_grams_are_those_of_each_window():
    rng = np.random.default_rng(1)
    for n in (0, 5, 34, 35, 36, 400):
        data = rng.integers(97, 100, n).astype(np.uint8)
        h = grams.gram_hashes(data, 12)
        assert grams.least_grams(data, 12, 24).tolist() == sorted({min(h[i : i + 24].tolist()) for i in range(len(h) - 23)})


@pytest.mark.parametrize("seed", [1, 2])
def test_contained_equals_in(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "γάμμα", "delta", "x", "\U0001f600", "né"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [(k, text(rng.randrange(0, 60))) for k in range(150)] + [(900, ""), (901, None), (902, texts_of := "a" * 300)]
    cuts = lambda t: t[(i := rng.randrange(len(t) + 1)) : i + rng.choice((1, 2, 3, 5, 8, 20, 40, 90))]
    patterns = [(k, cuts(rng.choice(texts)[1] or "none")) for k in range(120)] + [(k, text(9)) for k in range(200, 220)] + [(300, ""), (301, None), (302, texts_of), (303, "a" * 40), (304, "a" * 301)]
    got = grams.contained(spark.createDataFrame(texts, "t long, text string").repartition(3), "t", "text", spark.createDataFrame(patterns, "p long, pattern string"), "p", "pattern").collect()
    want = {(t, p) for t, x in texts for p, y in patterns if x and y and y in x}
    assert {(r.t, r.p) for r in got} == want and len(got) == len(want) > 300
    none = grams.contained(spark.createDataFrame(texts, "t long, text string"), "t", "text", spark.createDataFrame([], "p long, pattern string"), "p", "pattern")
    assert none.count() == 0
    left = grams.undropped(spark.createDataFrame(texts, "t long, text string"), "t", "text", spark.createDataFrame([(1, "alpha beta")], "p long, pattern string"), "p", "pattern").collect()
    assert {r.t for r in left} == {t for t, x in texts if not x or "alpha beta" not in x}


def percentile(values, share):
    values = sorted(values)
    place = (len(values) - 1) * share
    a, b = values[math.floor(place)], values[math.ceil(place)]
    return a if a == b else a * (1 - (place - math.floor(place))) + b * (place - math.floor(place))


@pytest.mark.parametrize("most", [0, 200, 1 << 20])
def test_exact_percentiles(spark, most):
    rng = random.Random(3)
    groups = {
        "even": [rng.gauss(0, 1) for _ in range(400)], "odd": [float(rng.randrange(5)) for _ in range(333)], "one": [7.5], "two": [1.0, 2.0], "same": [3.0] * 700, "wide": [10.0 ** rng.randrange(-300, 300) * rng.choice((1, -1)) for _ in range(250)],
        "tiny": [5e-324, 0.0, -5e-324, 1e-310], "huge": [1.7e308, -1.7e308, 1.0, 2.0, 3.0], "near": [1.0 + k * 2**-52 for k in range(300)], "infinite": [math.inf, -math.inf, 1.0, 2.0, 2.5], None: [4.0, 9.0, 1.0],
    }
    rows = [(g, 1, v) for g, vs in groups.items() for v in vs] + [("none", 1, None), ("odd", 1, None), ("odd", None, 5.0)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, h int, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.h, r.share): (r.percentile, r.samples) for r in quantiles.exact_percentiles(frame, ["g", "h"], "v", shares, most=most).collect()}
    want = {(g, 1, s): (percentile(vs, s), len(vs)) for g, vs in groups.items() for s in shares} | {("odd", None, s): (5.0, 1) for s in shares}
    assert got.keys() == want.keys()
    for k, (value, n) in want.items():
        assert got[k][1] == n and (got[k][0] == value or math.isclose(got[k][0], value, rel_tol=1e-12, abs_tol=0) or math.isnan(value)), k
    if most == 0:
        whole = quantiles.exact_percentiles(frame.where("g IN ('even', 'odd')"), [], "v", [0.5], most=0).collect()
        assert [(r.percentile, r.samples) for r in whole] == [(statistics.median([*groups["even"], *groups["odd"], 5.0]), 734)]
    spread = {r.g: (r.median, r.samples, r.mad) for r in quantiles.median_and_mad(frame.where("h = 1 AND g IN ('even', 'odd', 'one', 'same')"), ["g"], "v", most=most).collect()}
    for g in ("even", "odd", "one", "same"):
        m = statistics.median(groups[g])
        assert spread[g] == pytest.approx((m, len(groups[g]), statistics.median(abs(v - m) for v in groups[g])), rel=1e-12)


def test_intervals_around_points(spark):
    rng = random.Random(4)
    spans = [(g, f"s{g}-{k}", (a := rng.randrange(-300, 300)), a + rng.choice((0, 1, 2, 3, 7, 30, 200, 1000, -1))) for g in (1, 2) for k in range(90)] + [(1, "far", -(10**12), 10**12)]
    points = [(k, rng.choice((1, 2, 3)), rng.randrange(-400, 400)) for k in range(300)] + [(900, 1, 10**12), (901, 1, 10**12 + 1), (902, 1, None)]
    s, p = spark.createDataFrame(spans, "g int, span string, a long, b long"), spark.createDataFrame(points, "id long, g int, at long")
    around = {k: [(b - a, n) for h, n, a, b in spans if h == g and at is not None and a <= at <= b] for k, g, at in points}
    got = {(r.id, r.span) for r in containment.containing(p, "id", "at", s, "span", "a", "b", ["g"]).collect()}
    assert got == {(k, n) for k, hits in around.items() for _, n in hits}
    for r in containment.innermost(p, "id", "at", s, "span", "a", "b", ["g"]).collect():
        hits = sorted(around[r.id])
        assert (r.around, r.span, r.alone) == ((len(hits), hits[0][1], sum(h[0] == hits[0][0] for h in hits) == 1) if hits else (0, None, None))


def test_innermost_sends_a_row_of_a_point_and_level(spark, monkeypatch):
    """Before, every pair of a point and an interval was written and sent."""
    written = []
    monkeypatch.setattr(containment, "checkpointed", lambda df: written.append(df) or df)
    s = spark.range(400).selectExpr("1 AS g", "id AS span", "0L AS a", "1000 + id AS b")
    p = spark.range(50).selectExpr("id", "1 AS g", "id AS at")
    rows = containment.innermost(p, "id", "at", s, "span", "a", "b", ["g"]).collect()
    assert {(r.around, r.span, r.alone) for r in rows} == {(400, 0, True)} and len(rows) == 50
    assert not written


def test_findings_lead_to_the_one_job_and_step(spark):
    found = spark.createDataFrame([("1", "w.yml", 5), ("2", "w.yml", 8), ("3", "w.yml", 40), ("4", "x.py", 1), ("5", "w.yml", 21), ("6", "w.yml", None), ("7", "v.yml", 4)], "id string, file string, line int")
    jobs = spark.createDataFrame([("w.yml", "a", 3, 10), ("w.yml", "b", 20, 30), ("v.yml", "c", 1, 9), ("v.yml", "d", 4, 6)], "file string, job string, first int, last int")
    steps = spark.createDataFrame([("w.yml", "a", "s1", 4, 6), ("w.yml", "b", "s2", 21, 22), ("w.yml", "b", "s3", 21, 25), ("v.yml", "c", "s4", 3, 5)], "file string, job string, step string, first int, last int")
    got = {r.id: (r.level, r.job, r.step) for r in containment.linked_findings(found, jobs, steps).collect()}
    assert got == {"1": ("step", "a", "s1"), "2": ("job", "a", None), "3": ("workflow", None, None), "4": ("none", None, None), "5": ("job", "b", None), "6": ("workflow", None, None), "7": ("workflow", None, None)}


def test_pattern_queries_equal_sql_on_odd_rows(spark, tmp_path):
    import duckdb

    from emberlens.plans.registry import ORACLES, QUERIES

    long = "Große Straßen führen ins weite Tal, und ᾳ steht ŉ allein."
    items = [(0, long), (1, "ab"), (2, "short one"), (2, "another of the same id, longer than a window of grams"), (None, "nobody's item"), (3, None)]
    docs = [(1, f"x {duckdb.sql('SELECT upper(?)', params=[long]).fetchall()[0][0]} y"), (2, long.upper()), (None, f"- {long} -"), (None, "another of the same id, longer than a window of grams"), (4, "short one"), (4, "nobody's item"), (5, None), (6, "")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, x, "en") for k, x in docs], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    for t in ("benchmark", "documents"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("pattern_texts", "obs13_undropped"):
        got = sorted(map(repr, map(tuple, QUERIES[name](spark, str(tmp_path)).collect())))
        assert got == sorted(map(repr, db.sql(ORACLES[name]).fetchall())), name
