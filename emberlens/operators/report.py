"""Findings between scans, hub tables and report totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(before: DataFrame, after: DataFrame, key: str, scope: str, comparable: DataFrame) -> DataFrame:
    """persisting, new, gone or unknown for each fingerprint; a scope that both scans did not evaluate alike stays unknown.

    ``comparable`` has one row for each scope evaluated by both."""
    a = before.select(F.col(key), F.col(scope).alias("_a"), F.lit(True).alias("_before"))
    b = after.select(F.col(key), F.col(scope).alias("_b"), F.lit(True).alias("_after"))
    both = a.join(b, key, "full").select(key, F.coalesce("_b", "_a").alias(scope), "_before", "_after")
    out = both.join(comparable.select(scope, F.lit(True).alias("_same")), scope, "left")
    state = F.when(F.col("_before") & F.col("_after"), "persisting").when(F.col("_same").isNull(), "unknown").when(F.col("_after"), "new").otherwise("gone")
    return out.select(key, scope, state.alias("state"))


def committed(findings: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Findings whose result marker was written."""
    return findings.join(results.select(key).distinct(), key, "left_semi")


def totals(findings: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts by a class with a row for every value of the class, 0 where nothing has it."""
    spark = findings.sparkSession
    every = spark.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(findings.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def top(rows: DataFrame, column: str, first_seen: str, k: int) -> DataFrame:
    """The k most common values; ties keep the order in which they were seen first."""
    agg = rows.groupBy(column).agg(F.count("*").alias("n"), F.min(first_seen).alias("first_seen"))
    return agg.orderBy(F.desc("n"), "first_seen", column).limit(k)


def summarized_limitations(limits: DataFrame, reason: str, path: str, order: str, k: int = 12) -> DataFrame:
    """One row for each reason: count and first example; at most k reasons."""
    agg = limits.groupBy(reason).agg(F.count("*").alias("n"), F.min_by(path, order).alias("example"))
    return agg.orderBy(F.desc("n"), reason).limit(k)


def violations(sources: DataFrame, scopes: DataFrame, findings: DataFrame, fingerprint: Column) -> DataFrame:
    """Contract rules over one payload's child tables, a row for each violation: (rule, key); accepted if empty.

    sources: source_id, scope_id; scopes: scope_id, evaluated; findings: fingerprint, scope_id, source_id and the columns of ``fingerprint``."""
    rules = {
        "duplicate source": sources.groupBy("source_id").count().where("count > 1").select("source_id"),
        "source out of scope": sources.join(scopes, "scope_id", "left_anti").select("source_id"),
        "duplicate fingerprint": findings.groupBy("fingerprint").count().where("count > 1").select("fingerprint"),
        "wrong fingerprint": findings.where(F.col("fingerprint") != fingerprint).select("fingerprint"),
        "finding out of evaluated scope": findings.join(scopes.where("evaluated"), "scope_id", "left_anti").select("fingerprint"),
        "evidence without source": findings.join(sources, ["source_id", "scope_id"], "left_anti").select("fingerprint"),
    }
    out = None
    for rule, rows in rules.items():
        part = rows.toDF("key").select(F.lit(rule).alias("rule"), F.col("key").cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def ordinals(hits: DataFrame, scope: list[str], anchor: str, order: list[str]) -> DataFrame:
    """``identity``: the anchor, with #2, #3 ... for repeats in line order, so that identities hold no line numbers."""
    from pyspark.sql import Window

    from ..functions.contract import suffixed

    n = F.row_number().over(Window.partitionBy(*scope, anchor).orderBy(*order))
    return hits.withColumn("identity", suffixed(F.col(anchor), n))
