"""Weighted stacks, memory series and line profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import status


def hotspots(stacks: DataFrame, profile: str, frames: str, weight: str, min_self: float = 0.1, min_inclusive: float = 0.5, min_samples: float = 1000, most_callee: float | None = None) -> DataFrame:
    """OBS-19: self (leaf) and inclusive (once a stack) weight of each function; frames run from root to leaf.

    With ``most_callee``, a function of which one callee has a larger share only passes its weight on."""
    total = stacks.groupBy(profile).agg(F.sum(weight).alias("total"))
    leaf = F.element_at(frames, -1)
    exploded = stacks.select(profile, F.col(weight).alias("_w"), leaf.alias("_leaf"), F.element_at(frames, 1).alias("_root"), F.explode(F.array_distinct(frames)).alias("function"))
    pick = lambda c: F.sum(F.when(F.col("function") == F.col(c), F.col("_w")).otherwise(0))
    agg = exploded.groupBy(profile, "function").agg(F.sum("_w").alias("inclusive"), pick("_leaf").alias("self"), pick("_root").alias("root"))
    out = agg.join(total, profile)
    passes = F.lit(False)
    if most_callee is not None:
        heaviest = callee_edges(stacks, profile, frames, weight).groupBy(profile, F.col("caller").alias("function")).agg(F.max("weight").alias("_callee"))
        out = out.join(heaviest, [profile, "function"], "left")
        passes = F.coalesce(F.col("_callee") > most_callee * F.col("inclusive"), F.lit(False))
    hit = (F.col("self") > min_self * F.col("total")) | ((F.col("inclusive") > min_inclusive * F.col("total")) & (F.col("root") == 0) & (F.col("inclusive") <= 0.9 * F.col("total")) & ~passes)
    return out.withColumn("status", status(F.col("total") >= min_samples, hit)).drop("_callee")


def callee_edges(stacks: DataFrame, profile: str, frames: str, weight: str) -> DataFrame:
    """Weight of each caller-callee edge, an edge once a stack."""
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(frames) - 1), lambda i: F.struct(F.element_at(frames, i).alias("caller"), F.element_at(frames, i + 1).alias("callee"))))
    rows = stacks.where(F.size(frames) > 1).select(profile, F.col(weight).alias("_w"), F.explode(pairs).alias("e"))
    return rows.groupBy(profile, F.col("e.caller").alias("caller"), F.col("e.callee").alias("callee")).agg(F.sum("_w").alias("weight"))


def leaks(series: DataFrame, by: list[str], order: str, amount: str, min_growth: float, min_monotonic: float = 0.8, min_snapshots: int = 5) -> DataFrame:
    """OBS-19: series that keep growing; the later half must carry its part of the growth."""
    w = Window.partitionBy(*by).orderBy(order)
    n = F.count("*").over(Window.partitionBy(*by))
    rows = series.select(*by, order, F.col(amount).alias("v"), F.lag(amount).over(w).alias("before"), F.row_number().over(w).alias("i"), n.alias("n"))
    agg = rows.groupBy(*by).agg(
        F.count("*").alias("snapshots"), F.min_by("v", "i").alias("first"), F.max_by("v", "i").alias("last"), F.max_by("v", F.when(F.col("i") <= (F.col("n") + 1) / 2, F.col("i"))).alias("middle"),
        F.count_if(F.col("v") >= F.col("before")).alias("rising"),
    )
    growth = F.col("last") - F.col("first")
    hit = (growth >= min_growth) & (F.col("rising") >= min_monotonic * (F.col("snapshots") - 1)) & (2 * (F.col("last") - F.col("middle")) >= growth * 0.5)
    return agg.select(*by, "snapshots", F.round(growth, 2).alias("growth"), "rising", status(F.col("snapshots") >= min_snapshots, hit).alias("status"))


def line_shares(candidates: DataFrame, samples: DataFrame, file: str, first: str, last: str, line: str, weight: str, min_share: float) -> DataFrame:
    """PY-01/05/11: share of a file's samples within each candidate's span of lines, and its heaviest line."""
    total = samples.groupBy(file).agg(F.sum(weight).alias("total"))
    inside = candidates.join(samples, file).where(F.col(line).between(F.col(first), F.col(last)))
    agg = inside.groupBy(file, first, last).agg(F.sum(weight).alias("weight"), F.max(F.struct(F.col(weight), (-F.col(line)).alias("l"))).alias("top"))
    out = agg.join(total, file).select(file, first, last, "weight", "total", (-F.col("top.l")).alias("heaviest_line"))
    return out.withColumn("status", F.when(F.col("weight") >= min_share * F.col("total"), "detected").otherwise("clean"))


def churn(allocations: DataFrame, profile: str, n: str, n_bytes: str, peak: str, third_party: Column, min_ratio: float = 20, min_count: int = 1000, min_share: float = 0.05) -> DataFrame:
    """CODE-C6.1: own allocation sites of a profile that allocates far more than it ever holds."""
    total = allocations.groupBy(profile).agg(F.sum(n_bytes).alias("total_bytes"), F.max(peak).alias("peak_bytes"))
    rows = allocations.where(~third_party).join(total, profile)
    hit = (F.col("total_bytes") >= min_ratio * F.col("peak_bytes")) & (F.col(n) >= min_count) & (F.col(n_bytes) >= min_share * F.col("total_bytes"))
    return rows.withColumn("status", F.when(hit, "detected").otherwise("clean"))
