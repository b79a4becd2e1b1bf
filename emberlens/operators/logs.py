"""Log templates, event sizes and cache lookups: two-level folds with exact distinct counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contract import fingerprint, status
from ..functions.text import size_bucket, template


def template_counts(events: DataFrame, group: str, message: Column, slot: Column, fold_below: int = 10) -> DataFrame:
    """Per group and template: occurrences and distinct slots; rare templates fold into ``<other>``."""
    first = events.select(F.col(group), template(message).alias("template"), slot.alias("_slot")).groupBy(group, "template")
    counts = first.agg(F.count("*").alias("n"), F.countDistinct("_slot").alias("slots"))
    folded = F.when(F.col("n") < fold_below, "<other>").otherwise(F.col("template"))
    return counts.groupBy(group, folded.alias("template")).agg(F.sum("n").alias("occurrences"), F.sum("slots").alias("slots"), F.count("*").alias("templates"))


@dataclass(frozen=True)
class Repeats:
    min_events: int = 100
    min_occurrences: int = 50
    min_share: float = 0.2


# Lines that the platform writes.
PLATFORM = "^(START|END|REPORT) RequestId: |\"type\"[ \t]*:[ \t]*\"platform[.]"


def repeated_lines(counts: DataFrame, group: str, s: Repeats = Repeats(), invocations: DataFrame | None = None) -> DataFrame:
    """OBS-11: templates with a large share of a group's own events. Shares are compared by cross-multiplied integers.

    With ``invocations`` (group, invocations, invocation_slots), a template that is spread as invocations are, and occurs at
    most twice in each, belongs to requests and is no hit. Platform lines count for nothing."""
    own = ~F.col("template").rlike(PLATFORM)
    total = counts.groupBy(group).agg(F.sum(F.when(own, F.col("occurrences")).otherwise(0)).alias("events"))
    hit = (F.col("occurrences") > s.min_occurrences) & (F.col("occurrences") > s.min_share * F.col("events")) & (F.col("template") != "<other>") & own
    rows = counts.join(total, group)
    if invocations is not None:
        rows = rows.join(invocations, group, "left")
        spread = (F.col("occurrences") * F.col("invocation_slots") <= 2 * F.col("invocations") * F.col("slots")) & (F.col("occurrences") <= 2 * F.col("invocations"))
        hit = hit & ~F.coalesce(spread, F.lit(False))
    return rows.withColumn("status", status(F.col("events") >= s.min_events, hit)).drop("invocations", "invocation_slots")


def size_histogram(events: DataFrame, by: list[str], chars: Column) -> DataFrame:
    """OBS-17: events and characters in buckets of 512, the last one open."""
    return events.groupBy(*by, size_bucket(chars).alias("bucket")).agg(F.count("*").alias("events"), F.sum(chars).cast("long").alias("chars"), F.max(chars).cast("long").alias("max_chars"))


def oversized(histogram: DataFrame, by: list[str], limit: int, max_share: float, min_events: int) -> DataFrame:
    """OBS-17: share of the characters that lies in buckets beyond ``limit``."""
    large = F.sum(F.when(F.col("bucket") > limit // 512, F.col("chars")).otherwise(0))
    agg = histogram.groupBy(*by).agg(F.sum("events").alias("events"), F.sum("chars").alias("chars"), large.alias("large_chars"))
    return agg.withColumn("status", status(F.col("events") >= min_events, F.col("large_chars") > max_share * F.col("chars")))


def cache_holders(lookups: DataFrame, cache: str, key: str, holder: str, hit: Column, cap: int = 20) -> DataFrame:
    """LLM-12: keys of each cache by the number of holders that missed them."""
    missed = F.countDistinct(F.when(~hit, F.col(holder)))
    per_key = lookups.groupBy(cache, key).agg(F.count("*").alias("lookups"), F.count_if(hit).alias("hits"), missed.alias("missing"))
    by = F.least(F.col("missing"), F.lit(cap)).alias("missed_by")
    return per_key.groupBy(cache, by).agg(F.count("*").alias("keys"), F.sum("lookups").alias("lookups"), F.sum("hits").alias("hits"), F.sum("missing").alias("missing_holders"))


def isolated_caches(holders: DataFrame, cache: str, repository: str, min_lookups: int = 100, min_redundant: int = 20, min_share: float = 0.1) -> DataFrame:
    """LLM-12: misses that another holder of the same cache could have answered, with the finding's fingerprint."""
    redundant = F.sum(F.when(F.col("missed_by") >= 2, F.col("missing_holders") - F.col("keys")).otherwise(0))
    agg = holders.groupBy(cache).agg(F.sum("lookups").alias("lookups"), F.sum("hits").alias("hits"), redundant.alias("redundant"))
    hit = (F.col("redundant") > min_redundant) & (F.col("redundant") > min_share * F.col("lookups"))
    out = agg.withColumn("status", status(F.col("lookups") >= min_lookups, hit))
    scope = F.concat(F.lit("cache:"), F.col(cache))
    return out.withColumn("fingerprint", F.when(F.col("status") == "detected", fingerprint(F.lit(repository), F.lit("LLM-12"), scope, F.lit("isolated-caches"))))
