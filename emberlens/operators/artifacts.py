"""Measured artifacts: A/B benchmarks, model servers, tests, pages, and SQL that a request ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import status
from .quantiles import median_and_mad


def median_and_spread(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact median and median absolute deviation of each group."""
    return median_and_mad(samples, by, value)


def compared(samples: DataFrame, case: str, arm: str, metric: str, value: str, environment: str, target: str, cpu: str, min_improvement: float, max_regression: float, min_samples: int = 5) -> DataFrame:
    """NET-08 and NET-10: whether arm b improves ``target`` on a by a share that exceeds both arms' noise, while ``cpu`` grows by no more than a share.

    Arms that were measured in different environments, or too seldom, are omitted."""
    stats = median_and_spread(samples.where(F.col(metric).isin(target, cpu)), [case, arm, metric], value)
    wide = stats.groupBy(case).pivot(metric, [target, cpu])
    pick = lambda a, c: F.max(F.when(F.col(arm) == a, F.col(c)))
    wide = wide.agg(*(pick(a, c).alias(f"{a}_{c}") for a in "ab" for c in ("median", "mad", "samples")))
    places = samples.groupBy(case).agg(F.countDistinct(environment).alias("environments"))
    of = lambda m, a, c: F.col(f"{m}_{a}_{c}")
    gain = (of(target, "a", "median") - of(target, "b", "median")) / F.nullif(of(target, "a", "median"), F.lit(0.0))
    noise = (of(target, "a", "mad") + of(target, "b", "mad")) / F.nullif(of(target, "a", "median"), F.lit(0.0))
    slower = of(cpu, "b", "median") > of(cpu, "a", "median") * (1 + max_regression)
    enough = (F.col("environments") == 1) & (F.least(*(of(m, a, "samples") for m in (target, cpu) for a in "ab")) >= min_samples) & of(cpu, "a", "median").isNotNull() & of(cpu, "b", "median").isNotNull()
    out = wide.join(places, case).withColumns({"improvement": gain, "noise": noise})
    return out.select(case, "improvement", "noise", status(enough, (F.col("improvement") >= min_improvement) & (F.col("improvement") > F.col("noise")) & ~slower).alias("status"))


def engine_metrics(servers: DataFrame, min_requests: int = 100) -> DataFrame:
    """LLM-19 on a server's own counters: one row for each rule that fires, or one without a rule."""
    rules = {
        "preemptions": F.col("preemptions") > 0.01 * F.col("requests"),
        "cache full": F.col("kv_cache_usage_max") > 0.95,
        "prefix cache unused": F.col("prefix_cache_hit_rate") < 0.05,
        "length reserved": F.col("max_model_len") > 4 * F.col("max_request_tokens"),
    }
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    enough = F.coalesce(F.col("requests") >= min_requests, F.lit(False))
    rows = servers.select("server_id", "requests", F.explode_outer(F.when(enough, found)).alias("rule"))
    return rows.select("server_id", "rule", status(F.coalesce(F.col("requests") >= min_requests, F.lit(False)), F.col("rule").isNotNull()).alias("status"))


def slow_tests(tests: DataFrame, limits: dict[str, float]) -> DataFrame:
    """TST-12 on measured tests: the fields over their limits; sleeps and network calls are sure signs."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value"), F.lit(float(m)).alias("most")) for c, m in limits.items()))
    rows = tests.select("test_id", F.explode(pairs).alias("p")).where("p.value > p.most")
    sure = F.bool_or(F.col("p.field").isin("sleep_seconds", "network_call_count"))
    return rows.groupBy("test_id").agg(F.array_join(F.array_sort(F.collect_list("p.field")), ",").alias("fields"), F.when(sure, "high").otherwise("medium").alias("confidence"))


#: rule, field, smallest value that is found
PAGE_RULES = (("FE-11", "unminified_ms", 50.0), ("FE-13", "unused_bytes", 10240.0), ("FE-15", "reflow_ms", 30.0), ("FE-16", "nodes", 1401.0), ("FE-02", "lazy_lcp", 1.0), ("FE-10", "undiscoverable", 1.0))


def page_fields(audits: DataFrame) -> DataFrame:
    """FE-02, 10, 11, 13, 15 and 16 on audit fields (page, resource, field, value): values of one resource add up."""
    total = audits.groupBy("page", "resource", "field").agg(F.sum("value").alias("value"))
    known = F.array(*(F.struct(F.lit(r).alias("check_id"), F.lit(f).alias("field"), F.lit(v).alias("least")) for r, f, v in PAGE_RULES))
    rules = F.filter(known, lambda x: x["field"] == F.col("field"))
    return total.withColumn("r", F.explode(rules)).select("r.check_id", "page", "resource", "value", F.when(F.col("value") >= F.col("r.least"), "detected").otherwise("clean").alias("status"))


def unique_suffix(urls: DataFrame, files: DataFrame) -> DataFrame:
    """url and the repository file whose path ends as the url's does, where only one does; urls: url, path."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    own = urls.select("url", F.col("path").alias("_p")).withColumn("_n", name(F.col("_p")))
    there = files.select(F.col("path").alias("file")).withColumn("_n", name(F.col("file")))
    fits = own.join(there, "_n").where(F.col("_p").endswith(F.concat(F.lit("/"), F.col("file"))) | (F.col("_p") == F.col("file")) | F.col("file").endswith(F.concat(F.lit("/"), F.ltrim(F.col("_p"), F.lit("/")))))
    return fits.groupBy("url").agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n = 1").select("url", "file")


def confirmed(findings: DataFrame, functions: DataFrame, min_share: float) -> DataFrame:
    """JS-02 to JS-08: static candidates (path, line) in functions that a profile (path, line, share) finds heavy; unmeasured ones are omitted."""
    rows = findings.join(functions.select("path", "line", "share"), ["path", "line"], "left")
    return rows.withColumn("status", status(F.col("share").isNotNull(), F.col("share") >= min_share))


# Queries of requests: request, transaction, n (order), variable, query, and used (whether the result was read before the variable's next write)


def dead_store_queries(reads: DataFrame) -> DataFrame:
    """DB-05: a result that a later read of the same request, transaction and variable overwrites before any use."""
    w = Window.partitionBy("request", "transaction", "variable").orderBy("n")
    rows = reads.withColumn("next", F.lead("n").over(w))
    return rows.where(~F.col("used") & F.col("next").isNotNull()).select("request", "transaction", "variable", "n", "next")


def unused_queries(reads: DataFrame) -> DataFrame:
    """DB-16: an executed read that nothing uses, the last of its variable."""
    w = Window.partitionBy("request", "transaction", "variable").orderBy("n")
    return reads.withColumn("next", F.lead("n").over(w)).where(~F.col("used") & F.col("next").isNull()).select("request", "transaction", "variable", "n", "query")


def known_empty(predicates: DataFrame) -> DataFrame:
    """DB-06: predicates that no row passes; terms: query, branch (the ORs), left, op, right as literals, null for unknown values.

    A branch is an AND of its terms. As in SQL, a comparison with NULL is unknown, and unknown passes no row. Terms that
    name columns (``is_column``) can be true, unless the other side is NULL."""
    compare = (
        F.when(F.col("left").isNull() & ~F.col("is_column") | F.col("right").isNull(), F.lit(False)).when(F.col("is_column"), F.lit(True))
        .when(F.col("op") == "=", F.col("left") == F.col("right")).when(F.col("op") == "<>", F.col("left") != F.col("right")).when(F.col("op") == "<", F.col("left") < F.col("right")).when(F.col("op") == ">", F.col("left") > F.col("right"))
    )
    branch = predicates.groupBy("query", "branch").agg(F.bool_and(F.coalesce(compare, F.lit(True))).alias("may"))
    return branch.groupBy("query").agg(F.bool_or("may").alias("may")).select("query", F.when(F.col("may"), "clean").otherwise("detected").alias("status"))


def late_guards(steps: DataFrame) -> DataFrame:
    """DB-34: SQL built before the cache check that makes it needless; steps: function, n, kind (build, guard, run)."""
    first = steps.groupBy("function").agg(*(F.min(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("build", "guard", "run")))
    return first.where("build < guard AND guard < run").select("function", "build", "guard")


def clients_per_request(steps: DataFrame) -> DataFrame:
    """NET-04: handlers that construct a client and use it; steps: function, handler, client, kind (construct, use)."""
    kinds = steps.where("handler").groupBy("function", "client").agg(F.bool_or(F.col("kind") == "construct").alias("made"), F.bool_or(F.col("kind") == "use").alias("used"))
    return kinds.where("made AND used").select("function", "client")
