"""Reports of scans against plain assembly."""

import random
import re
from collections import Counter

from emberlens.operators import reports


def lines_by_hand(texts, most):
    grouped, general = {}, []
    for text in texts:
        m = re.match(r"^file:([^:]+): (.+)$", text)
        if m:
            grouped.setdefault(m[2].replace(m[1], "<file>"), []).append(m[1])
        else:
            general.append(text)
    files = [f"{p[0]}: {r.replace('<file>', p[0])}" if len(p) == 1 else f"{len(p)} files: {r} (e.g. {p[0]})" for r, p in grouped.items()]
    return (files + general)[:most]


def test_limitations_by_reason(spark):
    rng = random.Random(1)
    texts = lambda: [rng.choice((f"file:{(p := rng.choice('abcd') + '.py')}: {rng.choice(('too large', f'cannot read {p}', 'x: y'))}", f"note {rng.randrange(4)}", "file:without reason", "file:a:b: c", f"file:only{rng.randrange(99)}.py: rare {rng.randrange(20)}")) for _ in range(rng.randrange(30))]
    every = {(s, f"C{c}"): texts() for s in range(3) for c in range(6)}
    rows = spark.createDataFrame([(s, c, n, x) for (s, c), t in every.items() for n, x in enumerate(t)], "scan int, check_id string, n int, text string").repartition(4)
    got = {(r.scan, r.check_id): (r.lines, r.total) for r in reports.limitation_lines(rows, 5).collect()}
    assert got == {k: (lines_by_hand(t, 5), len(t)) for k, t in every.items() if t}


def test_a_scan_is_graded_ordered_and_summed(spark):
    runs = [("s", "B", "y", None, None, None, "completed"), ("s", "A", "z", None, None, None, "partial"), ("s", "C", "x", "boom", None, None, None), ("s", "D", "x", None, "off", None, None), ("s", "E", "x", None, None, "no files", None), ("s", "F", "x", "boom", None, None, "completed"), ("s", "G", "x", None, None, None, "completed"), ("t", "A", "x", None, None, None, "completed")]
    found = [("s", "B", "1", "low", None, None), ("s", "B", "2", "high", "b.py", 3), ("s", "A", "3", "high", "z.py", 9), ("s", "B", "4", "high", "b.py", 2), ("s", "G", "5", "high", "a.py", 1), ("s", "C", "6", "high", "a.py", 1), ("s", "B", "7", "high", None, 8)]
    frame = spark.createDataFrame
    r = frame(runs, "scan string, check_id string, owner string, error string, unavailable string, not_applicable string, result string")
    f = frame(found, "scan string, check_id string, id string, confidence string, file string, line int")
    taxonomy = frame([("A", "pa", "L1"), ("B", "pb", "L2"), ("Z", "pz", "L9")], "check_id string, pattern string, layer string")
    limits = frame([("s", "A", 1, "file:x: too large"), ("s", "G", 1, "hidden")], "scan string, check_id string, n int, text string")
    entries = reports.check_entries(r, taxonomy, f, limits, frame([("s", "G", "second"), ("s", "G", "first")], "scan string, check_id string, problem string"))
    got = {(e.scan, e.check_id): (e.status, e.status_source, e.reason, e.layer, e.finding_count, e.limitations, e.place) for e in entries.collect()}
    assert got == {
        ("s", "C"): ("error", "scanner", "boom", None, 0, [], 1), ("s", "D"): ("unavailable", "scanner", "off", None, 0, [], 2), ("s", "E"): ("not_applicable", "scanner", "no files", None, 0, [], 3), ("s", "F"): ("error", "scanner", "boom", None, 0, [], 4),
        ("s", "G"): ("error", "scanner", "invalid detector output rejected: first", None, 0, [], 5), ("s", "B"): ("completed", "detector", None, "L2", 4, [], 6), ("s", "A"): ("partial", "detector", None, "L1", 1, ["x: too large"], 7), ("t", "A"): ("completed", "detector", None, "L1", 0, [], 1),
    }
    listed = reports.report_findings(f, entries)
    assert [(x.id, x.owner) for x in sorted(listed.collect(), key=lambda x: x.place)] == [("3", "z"), ("7", "y"), ("4", "y"), ("2", "y"), ("1", "y")]
    s, t = sorted(reports.summary(entries, listed).collect(), key=lambda x: x.scan)
    assert s.checks_by_status == Counter(completed=1, partial=1, unavailable=1, error=3, not_applicable=1) and (s.checks_total, s.findings_total) == (7, 5)
    assert s.findings_by_confidence == {"high": 4, "medium": 0, "low": 1} and [tuple(x) for x in s.findings_by_layer] == [("L2", 4), ("L1", 1)] and [tuple(x) for x in s.findings_by_owner] == [("y", 4), ("z", 1)]
    assert (t.findings_total, t.findings_by_layer) == (0, None) and sum(t.findings_by_confidence.values()) == 0
