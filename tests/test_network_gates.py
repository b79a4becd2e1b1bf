"""The network rules' gates, case by case."""

import pytest
from pyspark.sql import functions as F

from emberlens.operators import network


@pytest.mark.parametrize(
    "header, want",
    [("gzip", True), (None, False), ("", False), ("identity", False), ("*", True), ("*;q=0", False), ("gzip;q=0, *", True), ("gzip;q=0,br;q=0,deflate;q=0,zstd;q=0,*", False), ("GZIP ; Q=0.001", True), ("x-gzip", False), ("gzip;q=1.5", None), ("gzip;q=", None), ("br,br", None), ("gzip;level=9;q=0", False), (", gzip ,", True), ("identity;q=x", None)],
)
def test_accepted_codings(spark, header, want):
    row = spark.createDataFrame([(header,)], "h string").select(network.accepts_compression(F.col("h")).alias("a")).first()
    assert row.a is want


def test_retry_groups(spark):
    """Groups of attempts (attempt, begin, end, status, client_retry, poll, retry_after) and what becomes of them."""
    three = [(1, 0, 1, 503, False, False, None), (2, 2, 3, 503, True, False, None), (3, 4, 5, 200, True, False, None)]
    change = lambda k, **new: [tuple(new.get(n, v) for n, v in zip(("attempt", "begin", "end", "status", "client_retry", "poll", "retry_after"), row, strict=True)) if i == k else row for i, row in enumerate(three)]
    groups = {
        "rapid": three, "slow": change(2, begin=400, end=401), "too few": three[:2], "fine before": change(1, status=200), "not a retry": change(1, client_retry=False), "poll": change(0, poll=True), "ignored": change(1, retry_after=5), "waited": change(1, retry_after=1),
        "missing": change(2, attempt=4), "twice": change(2, attempt=2), "overlap": change(1, begin=0), "429": change(0, status=429), "428": change(0, status=428), "from 2": [(a + 1, *rest) for a, *rest in three],
    }
    rows = spark.createDataFrame([(g, *r) for g, x in groups.items() for r in x], "g string, attempt int, begin long, end long, status int, client_retry boolean, poll boolean, retry_after long")
    policy = lambda backoff, jitter, cap: spark.createDataFrame([(g, backoff, jitter, cap) for g in groups], "g string, backoff boolean, jitter boolean, max_attempts int")
    judge = lambda p: {r.g: r.refused or r.reason for r in network.retry_storms(rows, ["g"], p, "g", 3, 100).collect()}
    refused = {"missing": "missing or duplicate attempt", "twice": "missing or duplicate attempt", "from 2": "missing or duplicate attempt", "overlap": "overlapping attempts"}
    none = dict.fromkeys(groups) | refused
    assert judge(policy(False, False, 0)) == none | {"rapid": "no delay", "waited": "no delay", "429": "no delay", "ignored": "Retry-After ignored"}
    assert judge(policy(True, False, 2)) == none | {g: "over the cap" for g in ("rapid", "waited", "429", "slow")} | {"ignored": "Retry-After ignored"}
    assert judge(policy(False, True, 3)) == none | {"ignored": "Retry-After ignored"}


def test_conversion_triples(spark):
    step = lambda op, digest="d", encoding="json", mutates=False, boundary=False, cpu=1.0: (op, digest, encoding, mutates, boundary, cpu)
    p, s = step("parse"), step("serialize")
    flows = {"chain": [p, s, p, s, p], "one": [p, s, p], "short": [p, s], "other content": [p, s, step("parse", "e")], "other encoding": [p, step("serialize", encoding="xml"), p], "mutated": [step("parse", mutates=True), s, p], "boundary at the end": [p, s, step("parse", boundary=True)], "boundary at the start": [step("parse", boundary=True), s, p], "reversed": [s, p, s]}
    rows = spark.createDataFrame([(f, i, *x) for f, steps in flows.items() for i, x in enumerate(steps)], "flow string, n int, operation string, digest string, encoding string, mutates boolean, boundary boolean, cpu double")
    got = {r.flow: (r.chains, r.waste, r.status) for r in network.conversion_chains(rows, "flow", ["n"], 2.0).collect()}
    assert got == {f: (0, 0.0, "clean") for f in flows} | {"chain": (2, 4.0, "detected"), "one": (1, 2.0, "detected"), "boundary at the start": (1, 2.0, "detected")}


def test_polls_with_an_event_beside_them(spark):
    polls = spark.createDataFrame([(u, k, "same" if k else "first", 10.0) for u in ("yes", "late", "lossy", "few") for k in range(2 if u == "few" else 6)], "u string, n int, answer string, every double")
    targets = spark.createDataFrame([("yes", 30, 30, False, True, True, True), ("late", 30, 31, False, True, True, True), ("lossy", 30, 1, False, True, True, False), ("few", 30, 1, False, True, True, True)], "u string, freshness int, delivery int, reconciliation boolean, supported boolean, reachable boolean, recovery boolean")
    got = {r.u: (r.changes, r.alternative, r.status) for r in network.event_alternatives(polls, "u", ["n"], "answer", F.col("every"), targets, 0.2, 5, 10).collect()}
    assert got == {"yes": (1, True, "detected"), "late": (1, False, "clean"), "lossy": (1, False, "clean"), "few": (1, True, "clean")}
