"""Requests between services: chatter, over-fetch, caching, polling, compression, duplicates, waterfalls and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import status
from .traces import previous


def chatty(calls: DataFrame, by: list[str], n_bytes: str, setup: str, min_calls: int, max_bytes: float) -> DataFrame:
    """NET-01: many small calls of one kind whose connection set-up costs something."""
    agg = calls.groupBy(*by).agg(F.count("*").alias("calls"), F.max(n_bytes).alias("largest"), F.round(F.sum(setup), 4).alias("setup"))
    return agg.withColumn("status", status(F.col("calls") >= min_calls, (F.col("largest") <= max_bytes) & (F.col("setup") > 0)))


def overfetch(fields: DataFrame, by: str, n_bytes: str, used: Column, min_share: float, min_fields: int) -> DataFrame:
    """NET-02: share of fetched bytes that nothing reads."""
    agg = fields.groupBy(by).agg(F.count("*").alias("fields"), F.round(F.sum(n_bytes), 2).alias("bytes"), F.round(F.sum(F.when(~used, F.col(n_bytes)).otherwise(0.0)), 2).alias("unused_bytes"))
    return agg.withColumn("status", status((F.col("fields") >= min_fields) & (F.col("bytes") > 0), F.col("unused_bytes") >= min_share * F.col("bytes")))


def uncached(requests: DataFrame, by: str, body: str, min_requests: int) -> DataFrame:
    """NET-03: a route whose responses repeat without a cache hit; body is the response's digest."""
    agg = requests.groupBy(by).agg(F.count("*").alias("requests"), F.countDistinct(body).alias("versions"))
    return agg.withColumn("repeats", F.col("requests") - F.col("versions")).withColumn("status", status(F.col("requests") >= min_requests, F.col("repeats") > 0))


def retries(attempts: DataFrame, by: list[str], order: list[str], second: Column, max_gap: float, min_attempts: int) -> DataFrame:
    """NET-05: gaps to the attempt before; a storm has many that are shorter than the back-off."""
    rows = attempts.withColumn("_s", second)
    gap = (F.col("_s") - previous("_s", by, order)).alias("gap")
    agg = rows.select(*by, gap).groupBy(*by).agg(F.count("*").alias("attempts"), F.count_if(F.col("gap") < max_gap).alias("rapid"), F.min("gap").alias("least_gap"))
    return agg.withColumn("status", status(F.col("attempts") >= min_attempts, F.col("rapid") >= min_attempts - 1))


def polling(polls: DataFrame, by: str, order: list[str], answer: str, max_share: float, min_polls: int) -> DataFrame:
    """NET-06: polls whose answer rarely differs from the one before."""
    rows = polls.select(by, (previous(answer, [by], order) != F.col(answer)).alias("changed"))
    agg = rows.groupBy(by).agg(F.count("*").alias("polls"), F.count_if("changed").alias("changes"))
    return agg.withColumn("status", status(F.col("polls") >= min_polls, F.col("changes") <= max_share * F.col("polls")))


def uncompressed(responses: DataFrame, key: str, n_bytes: Column, content_type: Column, accepts: Column, encoded: Column, min_bytes: int) -> DataFrame:
    """NET-07: text responses worth compressing that were sent plain although the client takes encodings."""
    reason = F.when(n_bytes < min_bytes, "small").when(~content_type.rlike("^(text/|application/(json|javascript|xml))"), "binary").when(~accepts, "not accepted").when(encoded, "encoded").otherwise("plain")
    return responses.select(key, n_bytes.cast("long").alias("bytes"), reason.alias("reason")).withColumn("status", F.when(F.col("reason") == "plain", "detected").otherwise("clean"))


def accept_quality(header: Column, coding: str) -> Column:
    """q of a coding in Accept-Encoding: an explicit entry wins over ``*``; absent is 0."""
    entries = F.transform(F.split(F.lower(F.regexp_replace(header, "[ \t]", "")), ","), lambda e: F.struct(F.regexp_extract(e, "^[^;]*", 0).alias("name"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(e, ";q=([0-9.]+)", 1), F.lit("")), F.lit("9.999")).cast("double"), F.lit(1.0)).alias("q")))
    named = lambda name: F.element_at(F.filter(entries, lambda e: e["name"] == name), 1)["q"]
    return F.coalesce(F.try_element_at(F.filter(entries, lambda e: e["name"] == coding), F.lit(1))["q"], F.try_element_at(F.filter(entries, lambda e: e["name"] == "*"), F.lit(1))["q"], F.lit(0.0))


def duplicates(requests: DataFrame, key: list[str]) -> DataFrame:
    """NET-11: requests repeated under one key."""
    return requests.groupBy(*key).agg(F.count("*").alias("requests")).where("requests > 1").withColumn("status", F.lit("detected"))


def waterfall(requests: DataFrame, by: str, start: str, end: str, min_requests: int) -> DataFrame:
    """NET-11: independent requests of one page that never overlap."""
    before = F.max(end).over(Window.partitionBy(by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    rows = requests.select(by, start, end, (F.col(start) < before).alias("overlaps"))
    agg = rows.groupBy(by).agg(F.count("*").alias("requests"), F.count_if("overlaps").alias("overlaps"))
    return agg.withColumn("status", status(F.col("requests") >= min_requests, F.col("overlaps") == 0))


def sweep(intervals: DataFrame, by: str, start: str, end: str, amount: str) -> DataFrame:
    """NET-09: the most that is live at once, from one sorted pass over starts and ends; ends free before starts take."""
    points = intervals.select(by, F.col(start).alias("at"), F.col(amount).alias("change"), F.lit(1).alias("n")).unionByName(intervals.select(by, F.col(end).alias("at"), (-F.col(amount)).alias("change"), F.lit(-1).alias("n")))
    net = points.groupBy(by, "at").agg(F.sum("change").alias("change"), F.sum("n").alias("n"))
    w = Window.partitionBy(by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    live = net.select(by, F.sum("change").over(w).alias("amount"), F.sum("n").over(w).alias("n"))
    return live.groupBy(by).agg(F.round(F.max("amount"), 2).alias("peak_amount"), F.max("n").alias("peak_count"))


def triples(steps: DataFrame, by: str, order: list[str], kind: str, first: str, second: str, cost: str) -> DataFrame:
    """NET-12: first-second-first in a row, with what the three cost."""
    w = Window.partitionBy(by).orderBy(*order)
    next_ = lambda c, k: F.lead(c, k).over(w)
    rows = steps.select(by, *order, ((F.col(kind) == first) & (next_(kind, 1) == second) & (next_(kind, 2) == first)).alias("hit"), (F.col(cost) + next_(cost, 1) + next_(cost, 2)).alias("cost"))
    return rows.where("hit").groupBy(by).agg(F.count("*").alias("triples"), F.round(F.sum("cost"), 2).alias("cost"))


def retry_storms(attempts: DataFrame, group: list[str], policies: DataFrame, by: str, min_attempts: int, min_delay: float) -> DataFrame:
    """NET-05 with its gates: one row for each group of correlated attempts, refused where they are no sequence 1 to n or overlap.

    attempts: group, attempt, begin, end, status, client_retry, poll, retry_after (null where the answer has none); policies: by,
    backoff, jitter, max_attempts. Failing client retries count; they violate the policy where a Retry-After was not waited
    for, where all of them come within ``min_delay`` and neither back-off nor jitter is set, or where they exceed the cap."""
    w = Window.partitionBy(*group).orderBy("attempt")
    gap = F.col("begin") - F.lag("end").over(w)
    later, last = F.lag("end").over(w).isNotNull(), F.lead("attempt").over(w).isNull()
    rows = attempts.select(
        *group, "attempt", gap.alias("_gap"), (gap < F.lag("retry_after").over(w)).alias("_ignored"), (later & ~F.col("client_retry")).alias("_other"), (~last & (F.col("status") < 429)).alias("_fine"), "poll"
    )
    agg = rows.groupBy(*group).agg(
        F.count("*").alias("attempts"), F.countDistinct("attempt").alias("_kinds"), F.min("attempt").alias("_first"), F.max("attempt").alias("_last"), F.min("_gap").alias("least_gap"), F.max("_gap").alias("_widest"),
        F.count_if("_ignored").alias("ignored"), F.count_if(F.col("_other") | F.col("_fine") | F.col("poll")).alias("_exempt"),
    ).join(policies.select(by, "backoff", "jitter", "max_attempts"), by)
    refused = F.when((F.col("_kinds") < F.col("attempts")) | (F.col("_first") != 1) | (F.col("_last") != F.col("attempts")), "missing or duplicate attempt").when(F.col("least_gap") < 0, "overlapping attempts")
    rapid = F.coalesce(F.col("_widest") < min_delay, F.lit(True)) & ~F.col("backoff") & ~F.col("jitter")
    over = (F.col("max_attempts") > 0) & (F.col("attempts") > F.col("max_attempts"))
    why = F.when(F.col("ignored") > 0, "Retry-After ignored").when(rapid, "no delay").when(over, "over the cap")
    out = agg.withColumn("refused", refused).withColumn("reason", F.when(F.col("refused").isNull() & (F.col("attempts") >= min_attempts) & (F.col("_exempt") == 0), why))
    state = F.when(F.col("refused").isNotNull(), "omitted").when(F.col("reason").isNotNull(), "detected").otherwise("clean")
    return out.select(*group, "attempts", "ignored", "refused", "reason", state.alias("status"))


def event_alternatives(polls: DataFrame, by: str, order: list[str], answer: str, interval: Column, targets: DataFrame, max_share: float, min_polls: int, max_interval: float) -> DataFrame:
    """NET-06 with its gates: polls that rarely change, where an event would be as fresh.

    targets: by, freshness, delivery (seconds), reconciliation, and supported, reachable and recovery of the event."""
    rows = polls.select(by, (previous(answer, [by], order) != F.col(answer)).alias("_changed"), interval.alias("_every"))
    agg = rows.groupBy(by).agg(F.count("*").alias("polls"), F.count_if("_changed").alias("changes"), F.round(F.avg("_every"), 4).alias("interval")).join(targets, by)
    usable = F.col("supported") & F.col("reachable") & F.col("recovery") & ~F.col("reconciliation") & (F.col("delivery") <= F.col("freshness"))
    hit = usable & (F.col("polls") >= min_polls) & (F.col("interval") <= max_interval) & (F.col("changes") <= max_share * F.col("polls"))
    return agg.select(by, "polls", "changes", "interval", usable.alias("alternative"), F.when(F.coalesce(hit, F.lit(False)), "detected").otherwise("clean").alias("status"))


def accepts_compression(header: Column) -> Column:
    """Whether any of the four codings has a positive quality; a malformed header, or one that names a coding twice, is null."""
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce(header, F.lit(""))), ","), lambda e: F.trim(e)), lambda e: F.trim(F.substring_index(e, ";", 1)) != "")
    names = F.transform(parts, lambda e: F.trim(F.substring_index(e, ";", 1)))
    q = lambda e: F.try_element_at(F.filter(F.transform(F.slice(F.split(e, ";"), 2, 8), lambda x: F.trim(x)), lambda x: x.startswith("q=")), F.lit(1))
    weight = lambda e: F.when(q(e).isNull(), 1.0).otherwise(F.expr("1.0") * F.try_to_number(F.nullif(F.regexp_extract(F.substring_index(q(e), "=", -1), "^(0([.][0-9]{0,3})?|1([.]0{0,3})?)$", 1), F.lit("")), F.lit("9.999")).cast("double"))
    weights = F.transform(parts, weight)
    of = lambda name: F.try_element_at(F.filter(F.arrays_zip(names.alias("n"), weights.alias("w")), lambda p: p["n"] == name), F.lit(1))["w"]
    sound = (F.size(F.array_distinct(names)) == F.size(names)) & ~F.exists(weights, lambda x: x.isNull())
    best = F.greatest(*(F.coalesce(of(k), of("*"), F.lit(0.0)) for k in ("gzip", "br", "deflate", "zstd")))
    return F.when(sound, best > 0)


def compressible(responses: DataFrame, key: str, min_bytes: int) -> DataFrame:
    """NET-07 with its gates: why each response is or isn't worth compressing.

    responses: key, method, status, body, ranged, streaming, reflects (secrets), busy (no CPU to spare), encoded, decoded (bytes),
    accept, encoding and type (headers)."""
    type_ = F.lower(F.trim(F.substring_index(F.coalesce("type", F.lit("")), ";", 1)))
    plain = F.lower(F.coalesce("encoding", F.lit("identity"))) == "identity"
    exempt = ~F.col("body") | (F.col("method") == "HEAD") | F.col("status").isin(204, 304, 206) | F.col("ranged") | F.col("streaming") | F.col("reflects") | F.col("busy")
    accepts = accepts_compression(F.col("accept"))
    reason = (
        F.when(exempt, "exempt").when(F.col("encoded") < min_bytes, "small").when(accepts.isNull(), "malformed").when(~accepts, "not accepted").when(~plain, "encoded").when(F.col("encoded") != F.col("decoded"), "sizes differ")
        .when(~type_.rlike(r"^(text/|application/(json|javascript|xml|.*\+json|.*\+xml)$)"), "binary").otherwise("plain")
    )
    out = responses.select(key, F.col("encoded").alias("bytes"), reason.alias("reason"))
    return out.withColumn("status", F.when(F.col("reason") == "plain", "detected").when(F.col("reason").isin("malformed", "sizes differ"), "omitted").otherwise("clean"))


def conversion_chains(steps: DataFrame, by: str, order: list[str], min_cpu: float) -> DataFrame:
    """NET-12 with its gates: CPU spent on writing and reading again what was read already.

    steps: by, order, operation (parse or serialize), digest, encoding, mutates, boundary (bytes are needed there), cpu. The
    triple must be of one content and encoding, unchanged, and its last two steps away from boundaries."""
    w = Window.partitionBy(by).orderBy(*order)
    at = lambda c, k: F.lead(c, k).over(w) if k else F.col(c)
    same = lambda c: (at(c, 0) == at(c, 1)) & (at(c, 1) == at(c, 2))
    kinds = (at("operation", 0) == "parse") & (at("operation", 1) == "serialize") & (at("operation", 2) == "parse")
    free = ~(at("mutates", 0) | at("mutates", 1) | at("mutates", 2) | at("boundary", 1) | at("boundary", 2))
    rows = steps.select(by, F.when(kinds & same("digest") & same("encoding") & free, at("cpu", 1) + at("cpu", 2)).alias("_waste"))
    agg = rows.groupBy(by).agg(F.count("*").alias("steps"), F.count("_waste").alias("chains"), F.round(F.coalesce(F.sum("_waste"), F.lit(0.0)), 4).alias("waste"))
    return agg.withColumn("status", F.when(F.col("waste") >= min_cpu, "detected").otherwise("clean"))
