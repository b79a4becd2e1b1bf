"""Contract rules over many payloads against a plain check of each."""

import random
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from emberlens.operators import payloads


def plain(p):
    """Violations of one payload: rule and key."""
    out, asked, done = [], set(p["scope"]), set(p["evaluated"])
    out += [("evaluated out of scope", s) for s in done - asked]
    status, idle = p["status"], len(done) + len(p["findings"]) + len(p["measurements"])
    if status == "completed" and done != asked:
        out.append(("completed must evaluate all", status))
    if status == "partial" and not (done and done < asked):
        out.append(("partial must evaluate some", status))
    if status in ("unavailable", "error") and idle:
        out.append(("unevaluated must be empty", status))
    if status != "completed" and not p["limits"]:
        out.append(("incomplete must explain", status))
    names = Counter(f for _, f, _ in p["findings"])
    out += [("finding out of evaluated scope", f) for s, f, _ in p["findings"] if s not in done]
    out += [("wrong fingerprint", f) for _, f, right in p["findings"] if f != right]
    out += [("duplicate fingerprint", f) for f, n in names.items() if n > 1]
    windows = Counter()
    for metric, unit, key, start, end in p["measurements"]:
        name = f"{metric}:{key}"
        if payloads.UNITS.get(metric) != unit:
            out.append(("metric and unit", name))
        try:
            a, b = (datetime.fromisoformat(x.replace("Z", "+00:00")) for x in (start, end))
            zoned = a.tzinfo is not None and b.tzinfo is not None
        except ValueError:
            zoned = False
        if not zoned:
            out.append(("timestamp without a zone", name))
            continue
        if a >= b:
            out.append(("start before end", name))
        windows[name, a, b] += 1
    return out + [("duplicate measurement", name) for (name, _, _), n in windows.items() if n > 1]


TIMES = ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:01Z", "2024-01-01T00:00:00", "2024-13-01T00:00:00Z", "2024-01-01 00:00Z", "soon", "2024-01-01T00:00:00.500Z", "2024-01-01T00:00:00+0100"]


def test_rules_equal_a_plain_check(spark):
    rng = random.Random(1)
    every = {}
    for k in range(120):
        scope = [f"s{j}" for j in range(rng.randrange(1, 4))]
        evaluated = rng.choice((scope, scope[:1], [], scope[:1] + ["other"], scope + scope[:1]))
        status = rng.choice(("completed", "completed", "partial", "unavailable", "error"))
        findings = [(rng.choice(scope), right if rng.random() < 0.8 else "wrong", right) for right in (f"f{rng.randrange(3)}" for _ in range(rng.choice((0, 0, 1, 3))))]
        measurements = [(rng.choice(("energy", "tokens", "other")), rng.choice(("kWh", "count")), f"a{rng.randrange(2)}", rng.choice(TIMES), rng.choice(TIMES)) for _ in range(rng.choice((0, 0, 1, 4)))]
        every[k] = {"status": status, "scope": scope, "evaluated": evaluated, "findings": findings, "measurements": measurements, "limits": ["x"] * rng.randrange(2)}
    frame = lambda rows, schema: spark.createDataFrame(rows, "payload long, " + schema)
    results = frame([(k, "C1" if k % 9 else "C2", p["status"]) for k, p in every.items()], "check_id string, status string")
    many = lambda name: frame([(k, x) for k, p in every.items() for x in p[name]], "scope_id string")
    findings = frame([(k, *f) for k, p in every.items() for f in p["findings"]], "scope_id string, fingerprint string, own string")
    measurements = frame([(k, *m) for k, p in every.items() for m in p["measurements"]], "metric string, unit string, allocation_key string, start string, end string")
    got = payloads.result_violations(results, many("scope"), many("evaluated"), findings, measurements, many("limits"), spark.createDataFrame([("C1",)], "check_id string"), F.col("own"))
    want = Counter((k, *v) for k, p in every.items() for v in plain(p)) + Counter((k, "unknown check", "C2") for k in every if k % 9 == 0)
    assert Counter(tuple(r) for r in got.collect()) == want and len({rule for _, rule, _ in want}) == 13
    sources = frame([(1, "a", "s0"), (1, "a", "s0"), (1, "b", "no"), (2, "a", "s0")], "source_id string, scope_id string")
    parts = payloads.input_violations(sources, frame([(1, "s0"), (2, "s0")], "scope_id string"))
    assert [sorted(tuple(r) for r in p.collect()) for p in parts] == [[(1, "duplicate source", "a")], [(1, "source out of scope", "b")]]
