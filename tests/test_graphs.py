"""Peeling and reachability against plain walks."""

import random

from emberlens.operators import graphs

NODES = "g long, n long, w double"
EDGES = "g long, n long, after_n long"


def longest(nodes, waits):
    """finish and level of each node, None where it can't be done, by memoised recursion with a path."""
    out = {}

    def visit(x, path):
        if x in out:
            return out[x]
        if x not in nodes or x in path:
            return None
        found = [visit(y, path | {x}) for y in waits.get(x, ())]
        value = None if None in found else (max((l for l, _ in found), default=-1) + 1, max((f for _, f in found), default=0.0) + nodes[x])
        if value is not None or not path:
            out[x] = value
        return value

    for x in nodes:
        out[x] = visit(x, frozenset())
    return out


def test_peel_equals_a_walk_with_cycles_copies_and_missing_nodes(spark):
    rng = random.Random(1)
    nodes, edges = {}, []
    for g in range(12):
        n = rng.randrange(1, 14)
        for k in range(n):
            nodes[(g, k)] = float(rng.randrange(1, 9))
        for _ in range(rng.randrange(0, 2 * n)):
            a, b = rng.randrange(n), rng.randrange(n + (g % 4 == 0))
            edges.append((g, max(a, b), min(a, b)) if g % 3 else (g, a, b))
    edges += edges[:5] + [(3, 0, 0)]
    waits = {}
    for g, a, b in edges:
        waits.setdefault((g, a), set()).add((g, b))
    want = longest(nodes, waits)
    frame = spark.createDataFrame([(*k, w) for k, w in nodes.items()], NODES)
    rows = graphs.peel(frame, spark.createDataFrame(edges, EDGES), ["g", "n"], "w").collect()
    assert {(r.g, r.n): None if r.blocked else (r.level, r.finish) for r in rows} == want and len(rows) == len(nodes)
    assert {r.blocked for r in rows} == {True, False}
    empty = spark.createDataFrame([], EDGES)
    assert {(r.level, r.finish) for r in graphs.peel(frame, empty, ["g", "n"], "w").collect()} == {(0, w) for w in nodes.values()}
    assert graphs.peel(frame.where("g < 0"), empty, ["g", "n"], "w").count() == 0


def walk(edges, entries, stops=()):
    """node -> fewest hops, and for these the least entry."""
    best = {}
    for e in sorted(entries):
        near, hops = {e}, 0
        seen = set()
        while near:
            for x in near:
                if x not in best or (hops, e) < best[x]:
                    best[x] = (hops, e)
            seen |= near
            near = {b for a, b in edges if a in near and a not in stops} - seen
            hops += 1
    return best


def test_reach_equals_a_breadth_first_walk(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)] + [(7, 7), (1, 2), (1, 2)] + [(100 + k, 101 + k) for k in range(9)]
    entries, stops = [1, 5, 100, 999], [2, 30, 104]
    e, s, t = (spark.createDataFrame(rows, schema) for rows, schema in ((edges, "src long, dst long"), ([(x,) for x in [*entries, 5]], "node long"), ([(x,) for x in stops], "node long")))
    assert {r.node: (r.hops, r.entry) for r in graphs.reach(e, s).collect()} == walk(edges, entries)
    assert {r.node: (r.hops, r.entry) for r in graphs.reach(e, s, stops=t).collect()} == walk(edges, entries, stops)
    assert {r.node for r in graphs.reach(e, s, most=2).collect()} == {n for n, (h, _) in walk(edges, entries).items() if h <= 2}
    each = {(r.entry, r.node, r.hops) for r in graphs.reach(e, s, each=True).collect()}
    assert each == {(x, n, h) for x in entries for n, (h, _) in walk(edges, [x]).items()}
    assert graphs.reach(e, s.where("node < 0")).count() == 0


def test_reached_counts_equal_the_closure(spark):
    rng = random.Random(5)
    ring = [(200 + k, 200 + (k + 1) % 6) for k in range(6)] + [(0, 200), (203, 300), (300, 301), (301, 300), (301, 302)]
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(7, 7), (1, 2), (1, 2)] + [(100 + k, 101 + k) for k in range(5)] + ring
    entries = [1, 5, 7, 100, 104, 204, 300, 302, 999]
    e, s = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(x,) for x in [*entries, 5, None]], "node long")
    assert {(r.entry, r.reached) for r in graphs.reached_counts(e, s).collect()} == {(x, len(walk(edges, [x]))) for x in entries} | {(None, 1)}
    # the members of a cycle are one component, so a cycle of n nodes makes no n * n rows
    roots = {r.node: r.root for r in graphs.cycles(e).where("node >= 200").collect()}
    assert roots == {200 + k: 200 for k in range(6)} | {300: 300, 301: 300}


def test_captures_are_refused_or_judged(spark):
    """Cases as the rule states them: two-request duplicates, a chain, a cycle, a missing one, polls, and overlaps."""
    rows, waits = [], []

    def capture(name, *requests, reviewed=True):
        for k, (key, begin, end, after, exempt) in enumerate(requests):
            rows.append((name, k, key, begin, end, exempt, reviewed))
            waits.extend((name, k, a) for a in after)

    capture("twice", ("a", 0.0, 1.0, (), False), ("a", 0.5, 2.0, (), False))
    capture("twice, one waits", ("a", 0.0, 1.0, (), False), ("a", 2.0, 3.0, (0,), False))
    capture("in turn", ("a", 0.0, 1.0, (), False), ("b", 1.5, 2.0, (), False), ("c", 9.0, 12.0, (1,), False))
    capture("in turn, not reviewed", ("a", 0.0, 1.0, (), False), ("b", 1.5, 2.0, (), False), reviewed=False)
    capture("too near", ("a", 0.0, 1.0, (), False), ("b", 1.2, 2.0, (), False))
    capture("polls", ("a", 0.0, 1.0, (), True), ("a", 2.0, 3.0, (), True))
    capture("cycle", ("a", 0.0, 1.0, (1,), False), ("b", 1.5, 2.0, (0,), False))
    capture("itself", ("a", 0.0, 1.0, (0,), False))
    capture("missing", ("a", 0.0, 1.0, (7,), False))
    out = graphs.browser_fetches(spark.createDataFrame(rows, "capture string, id int, key string, begin double, end double, exempt boolean, reviewed boolean"), spark.createDataFrame(waits, "capture string, id int, after_id int"), "capture", 2, 0.5)
    got = {r.capture: (r.refused, r.finding, r.critical, r.status) for r in out.collect()}
    assert got == {
        "twice": (None, "duplicate", 1.5, "detected"), "twice, one waits": (None, None, 2.0, "clean"), "in turn": (None, "independent waterfall", 3.5, "detected"), "in turn, not reviewed": (None, None, 1.0, "clean"),
        "too near": (None, None, 1.0, "clean"), "polls": (None, None, 1.0, "clean"), "cycle": ("cyclic dependency", None, None, "omitted"), "itself": ("cyclic dependency", None, None, "omitted"), "missing": ("missing dependency", None, None, "omitted"),
    }
