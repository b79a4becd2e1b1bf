"""Utilisation, bursts, disuse, label cardinality and retention: one aggregate for each resource, then gates and a rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import status
from .quantiles import exact_percentiles


@dataclass(frozen=True)
class Utilisation:
    min_days: float = 14
    min_samples: int = 100
    low_mean: float = 0.10
    low_peak: float = 0.50


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def span_days(ts: Column) -> Column:
    """Days between the first and last second, rounded to 2 digits."""
    return F.round((F.max(F.unix_timestamp(ts.cast("timestamp"))) - F.min(F.unix_timestamp(ts.cast("timestamp")))) / 86400, 2)


def over_provisioned(series: DataFrame, resource: str, ts: str, share: Column, s: Utilisation = Utilisation()) -> DataFrame:
    """INF-01: mean and peak of a share of capacity, judged once there are enough days and samples."""
    fine = ~F.isnan(share) & share.isNotNull()
    agg = series.where(fine).groupBy(resource).agg(
        F.count("*").alias("sample_count"), F.round(F.avg(clamp(share)), 4).alias("average_utilization"),
        F.round(F.max(clamp(share)), 4).alias("peak_utilization"), span_days(F.col(ts)).alias("window_days"),
    )
    enough = (F.col("window_days") >= s.min_days) & (F.col("sample_count") >= s.min_samples)
    hit = (F.col("average_utilization") < s.low_mean) & (F.col("peak_utilization") < s.low_peak)
    sure = F.when(hit & (F.col("peak_utilization") <= s.low_peak / 2), "high").when(hit, "medium")
    return agg.withColumn("status", status(enough, hit)).withColumn("confidence", F.when(enough, sure))


@dataclass(frozen=True)
class Bursts:
    low_median: float = 0.10
    high_peak: float = 0.50
    peak_ratio: float = 4.0
    min_samples: int = 24


def bursty(series: DataFrame, resource: str, share: Column, s: Bursts = Bursts()) -> DataFrame:
    """LLM-17: capacity that is idle by the exact median and still sees high peaks."""
    rows = series.select(resource, share.alias("_share")).where("_share IS NOT NULL")
    agg = rows.groupBy(resource).agg(F.count("*").alias("sample_count"), F.round(F.avg(clamp(F.col("_share"))), 4).alias("mean_utilization"), F.round(F.max("_share"), 4).alias("peak_utilization"))
    middle = exact_percentiles(rows, [resource], "_share", [0.5]).select(F.col(resource).alias("_of"), F.round("percentile", 6).alias("median_utilization"))
    agg = agg.join(middle, F.col(resource).eqNullSafe(F.col("_of"))).select(resource, "sample_count", "mean_utilization", "median_utilization", "peak_utilization")
    hit = (F.col("median_utilization") < s.low_median) & (F.col("peak_utilization") >= s.high_peak) & (F.col("peak_utilization") >= s.peak_ratio * F.col("mean_utilization"))
    return agg.withColumn("status", status(F.col("sample_count") >= s.min_samples, hit))


def no_use(activity: DataFrame, inventory: DataFrame, resource: str, day: str, amount: str, min_days: int, most: float) -> DataFrame:
    """INF-04: resources of the inventory whose activity stays at ``most``; without datapoints they are omitted, not clean."""
    seen = activity.groupBy(resource).agg(F.count(amount).alias("datapoints"), F.coalesce(F.sum(amount), F.lit(0)).alias("activity"), (F.datediff(F.max(day), F.min(day)) + 1).alias("observed_days"))
    every = inventory.select(resource).distinct().join(seen, resource, "left")
    out = every.select(resource, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("datapoints", "activity", "observed_days")))
    return out.withColumn("status", status((F.col("datapoints") > 0) & (F.col("observed_days") >= min_days), F.col("activity") <= most))


def cardinality(labels: DataFrame, metric: str, dimensions: dict[str, Column], most: int, most_ids: int, id_pattern: str = "^[0-9]{2,}$|^[0-9a-fA-F-]{16,}$") -> DataFrame:
    """OBS-06: exact distinct values of each dimension of a metric; values that all look like ids get the lower limit."""
    long = labels.select(metric, F.explode(F.create_map(*(x for k, v in dimensions.items() for x in (F.lit(k), v.cast("string"))))).alias("dimension", "value"))
    agg = long.where("value IS NOT NULL").groupBy(metric, "dimension").agg(F.countDistinct("value").alias("distinct_values"), F.count("*").alias("series"), F.bool_and(F.col("value").rlike(id_pattern)).alias("id_like"))
    hit = (F.col("distinct_values") > most) | (F.col("id_like") & (F.col("distinct_values") > most_ids))
    return agg.withColumn("status", status(F.lit(True), hit)).withColumn("confidence", F.when(hit & F.col("id_like"), "high").when(hit, "medium"))


# Names of labels and forms of values that tell requests or people apart.
ID_KEY = "^(?:aws)?(?:request|trace|span|correlation|session|user|customer|visitor|client|device|order|transaction|message|invocation|execution|event|job|cart)(?:id|uuid|guid|token|key)$|^(?:uuid|guid|email|emailaddress|ip|ipaddress|clientip|sourceip|remoteip|remoteaddr|url|uri|fullurl|rawurl|querystring)$"
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
ID_VALUE = f"(?i)^(?:{UUID}|[0-9a-f]{{16,}}|[0-9]{{8,}}|[0-9a-hjkmnp-tv-z]{{26}}|1-[0-9a-f]{{8}}-[0-9a-f]{{24}}|[^@ \t\r\n/]+@[^@ \t\r\n/]+[.][a-z]{{2,}}|[0-9]{{1,3}}(?:[.][0-9]{{1,3}}){{3}})$"
ID_PATH = f"(?i)/(?:[0-9]{{3,}}|[0-9a-f]{{16,}}|{UUID})(?:[/?#]|$)"
SAMPLES = 5


def label_cardinality(listing: DataFrame, metric: str, order: str, labels: str, complete: DataFrame, max_values: int, min_ids: int) -> DataFrame:
    """OBS-06 on a listing of series: distinct values of each label of a metric, a sample of them, and how sure a find is.

    listing: metric, order and a map of labels; complete: metric and whether its listing ended. A label is found above ``max_values``,
    or above ``min_ids`` where its name or all sampled values look like identifiers: both is high, many or the values' form
    medium, the name alone low. Metrics whose listing was cut are omitted. The sample is the first five values, which a
    ranked window limits before rows are sent, so a label with very many values doesn't meet in one place."""
    series = listing.groupBy(metric).agg(F.count("*").alias("series"))
    values = listing.select(metric, order, F.explode(labels).alias("label", "value")).groupBy(metric, "label", "value").agg(F.min(order).alias("_n"))
    counts = values.groupBy(metric, "label").agg(F.count("*").alias("distinct_values"))
    first = values.withColumn("_r", F.row_number().over(Window.partitionBy(metric, "label").orderBy("_n", "value"))).where(F.col("_r") <= SAMPLES)
    like = F.col("value").rlike(ID_VALUE) | F.col("value").rlike(ID_PATH)
    first = first.groupBy(metric, "label").agg(F.bool_and(like).alias("by_shape"), F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda x: x["value"]).alias("samples"))
    rows = counts.join(first, [metric, "label"]).join(series, metric).join(complete.select(metric, F.col("complete").alias("_complete")), metric, "left")
    rows = rows.withColumn("by_name", F.regexp_replace(F.lower("label"), "[^a-z0-9]", "").rlike(ID_KEY))
    over, ids = F.col("distinct_values") > max_values, F.col("by_name") | F.col("by_shape")
    hit, known = over | (ids & (F.col("distinct_values") > min_ids)), F.coalesce(F.col("_complete"), F.lit(False))
    sure = F.when(over & ids, "high").when(over | F.col("by_shape"), "medium").otherwise("low")
    out = rows.withColumns({"status": status(known, hit), "confidence": F.when(known & hit, sure)})
    return out.select(metric, "label", "series", "distinct_values", "by_name", "by_shape", "samples", "status", "confidence")


def hot_retention(groups: DataFrame, retention: str, stored: str, max_days: int, min_bytes: float, exempt: Column) -> DataFrame:
    """OBS-07: groups that keep much for longer than ``max_days`` or forever; a cascade, the first reason counts."""
    reason = (
        F.when(exempt, "exempt").when(F.col(stored) < min_bytes, "small").when(F.col(retention).isNull(), "never expires")
        .when(F.col(retention) > max_days, "too long").otherwise("fine")
    )
    return groups.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isin("never expires", "too long"), "detected").otherwise("clean"))
