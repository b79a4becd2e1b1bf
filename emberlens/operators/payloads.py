"""What a result must hold on its own: coverage, status, findings and measurements, for many payloads at once.

Payloads are relations keyed by ``payload``; each rule is a grouping or an anti join over all of them, and gives a row
(payload, rule, key) for each violation. A payload without rows is accepted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The unit of each metric.
UNITS = {"energy": "kWh", "emissions": "kgCO2e", "cpu_time": "seconds", "data_transfer": "bytes", "requests": "count", "tokens": "count", "log_volume": "bytes"}


def _rule(rows: DataFrame, name: str, key: Column | str) -> DataFrame:
    return rows.select("payload", F.lit(name).alias("rule"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"))


def _rules(rows: DataFrame, cases: list[tuple[Column, str]], key: str) -> DataFrame:
    """Several rules in one pass: a row for each case that holds."""
    broken = F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in cases)), lambda x: x.isNotNull())
    return rows.select("payload", F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def coverage_violations(results: DataFrame, scopes: DataFrame, evaluated: DataFrame, findings: DataFrame, measurements: DataFrame, limitations: DataFrame) -> list[DataFrame]:
    """Coverage against status. results: payload, status; scopes and evaluated: payload, scope_id; others: payload."""
    # one exchange by payload holds all that is counted; null scopes meet nothing, as in a join
    tag = lambda rows, kind, scope: rows.select("payload", F.lit(kind).alias("_kind"), scope.alias("scope_id"))
    none = F.lit(None).cast("string")
    parts = [tag(scopes, "asked", F.col("scope_id").cast("string")), tag(evaluated, "done", F.col("scope_id").cast("string")), *(tag(r, k, none) for r, k in ((findings, "found"), (measurements, "measured"), (limitations, "limits")))]
    has = lambda kind: F.count_if(F.col("_kind") == kind)
    per = reduce(DataFrame.unionByName, parts).repartition("payload").groupBy("payload", "scope_id").agg(*(has(k).alias(k) for k in ("asked", "done", "found", "measured", "limits")))
    both = (F.col("asked") > 0) & (F.col("done") > 0) & F.col("scope_id").isNotNull()
    sizes = per.groupBy("payload").agg(
        F.count_if(F.col("asked") > 0).alias("n_asked"), F.count_if(F.col("done") > 0).alias("n_done"), F.count_if(both).alias("n_both"),
        F.sum("found").alias("n_found"), F.sum("measured").alias("n_measured"), F.sum("limits").alias("n_limits"),
    )
    rows = results.select("payload", "status").join(sizes, "payload", "left").na.fill(0)
    outside = per.where((F.col("done") > 0) & ~both)
    partial = (F.col("n_done") > 0) & (F.col("n_both") == F.col("n_done")) & (F.col("n_done") < F.col("n_asked"))
    idle = F.col("n_done") + F.col("n_found") + F.col("n_measured")
    return [
        _rule(outside, "evaluated out of scope", "scope_id"),
        _rules(rows, [
            ((F.col("status") == "completed") & ((F.col("n_both") < F.col("n_asked")) | (F.col("n_done") > F.col("n_asked"))), "completed must evaluate all"),
            ((F.col("status") == "partial") & ~partial, "partial must evaluate some"),
            (F.col("status").isin("unavailable", "error") & (idle > 0), "unevaluated must be empty"),
            ((F.col("status") != "completed") & (F.col("n_limits") == 0), "incomplete must explain"),
        ], "status"),
    ]


def finding_violations(findings: DataFrame, evaluated: DataFrame, fingerprint: Column) -> list[DataFrame]:
    """findings: payload, scope_id, fingerprint and what ``fingerprint`` is made of."""
    copies = findings.groupBy("payload", "fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    return [
        _rule(findings.join(evaluated.select("payload", "scope_id").distinct(), ["payload", "scope_id"], "left_anti"), "finding out of evaluated scope", "fingerprint"),
        _rule(findings.where(~F.col("fingerprint").eqNullSafe(fingerprint)), "wrong fingerprint", "fingerprint"),
        _rule(copies, "duplicate fingerprint", "fingerprint"),
    ]


def measurement_violations(measurements: DataFrame) -> list[DataFrame]:
    """measurements: payload, metric, unit, allocation_key, start and end as texts with a zone."""
    unit = F.element_at(F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair)), F.col("metric"))
    # a time with a zone and an offset within a day; seconds and the offset's colon may be missing
    zoned = lambda c: F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)$")
    moment = lambda c: F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"([T ]\d{2}:\d{2})(Z|[+-].*)$", "$1:00$2"))
    rows = measurements.withColumns({"_start": moment("start"), "_end": moment("end"), "_key": F.concat_ws(":", "metric", "allocation_key")})
    rows = rows.withColumn("_ok", F.coalesce(zoned("start") & zoned("end") & F.col("_start").isNotNull() & F.col("_end").isNotNull(), F.lit(False)))
    sound = rows.where("_ok")
    copies = sound.groupBy("payload", "metric", "allocation_key", "_start", "_end", "_key").agg(F.count("*").alias("n")).where("n > 1")
    return [
        _rules(rows, [
            (~F.coalesce(unit == F.col("unit"), F.lit(False)), "metric and unit"),
            (~F.col("_ok"), "timestamp without a zone"),
            (F.col("_ok") & (F.col("_start") >= F.col("_end")), "start before end"),
        ], "_key"),
        _rule(copies, "duplicate measurement", "_key"),
    ]


def input_violations(sources: DataFrame, scopes: DataFrame) -> list[DataFrame]:
    """sources: payload, source_id, scope_id."""
    copies = sources.groupBy("payload", "source_id").agg(F.count("*").alias("n")).where("n > 1")
    return [_rule(copies, "duplicate source", "source_id"), _rule(sources.join(scopes.select("payload", "scope_id").distinct(), ["payload", "scope_id"], "left_anti"), "source out of scope", "source_id")]


def result_violations(results: DataFrame, scopes: DataFrame, evaluated: DataFrame, findings: DataFrame, measurements: DataFrame, limitations: DataFrame, checks: DataFrame, fingerprint: Column) -> DataFrame:
    """All rules of a result; results: payload, check_id, status; checks: the known check_id."""
    unknown = _rule(results.join(checks.select("check_id").distinct(), "check_id", "left_anti"), "unknown check", "check_id")
    parts = [unknown, *coverage_violations(results, scopes, evaluated, findings, measurements, limitations), *finding_violations(findings, evaluated, fingerprint), *measurement_violations(measurements)]
    return reduce(DataFrame.unionByName, parts)
