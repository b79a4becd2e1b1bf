"""Background jobs: request-path work, idle workers, schedule collisions, repeated runs and missing back-pressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import status
from .traces import islands, previous


def request_work(observations: DataFrame, job: str, milliseconds: str, least: float, min_requests: int) -> DataFrame:
    """JOB-01: work on the request path that is heavy in every observed request."""
    agg = observations.groupBy(job).agg(F.count("*").alias("requests"), F.bool_and(F.col(milliseconds) >= least).alias("always_heavy"), F.min(milliseconds).alias("least_ms"))
    return agg.withColumn("status", status(F.col("requests") >= min_requests, F.col("always_heavy")))


def idle_grid(samples: DataFrame, pool: str, ts: str, busy_above: int) -> DataFrame:
    """JOB-03: hours of the complete grid between a pool's first and last sample, and those with no more than ``busy_above``."""
    hour = F.date_trunc("hour", F.col(ts).cast("timestamp"))
    seen = samples.groupBy(pool, hour.alias("hour")).agg(F.count("*").alias("n"))
    grid = seen.groupBy(pool).agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select(pool, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    rows = grid.join(seen, [pool, "hour"], "left").select(pool, F.coalesce("n", F.lit(0)).alias("n"))
    return rows.groupBy(pool).agg(F.count("*").alias("hours"), F.count_if(F.col("n") <= busy_above).alias("idle_hours"), F.max("n").alias("peak"))


def collisions(runs: DataFrame, pool: list[str], key: list[str], start: str, end: str, cell: str = "DAY") -> DataFrame:
    """JOB-04: pairs of runs of one pool that overlap, each once.

    The run that starts later, by key where both start together, stands in the one cell of its start, the other in every
    cell that it lasts: the join has equal keys however long a pool's history is, and each pair meets once. Cells as short
    as the runs keep a busy pool's candidates near its overlaps."""
    at = lambda c: F.date_trunc(cell, F.col(c).cast("timestamp"))
    held = F.explode(F.sequence(at(start), at(end), F.expr(f"INTERVAL 1 {cell}"))).alias("cell")
    first = runs.select(*pool, F.struct(*key).alias("x"), F.col(start).alias("x_start"), F.col(end).alias("x_end"), held)
    later = runs.select(*pool, F.struct(*key).alias("y"), F.col(start).alias("y_start"), F.col(end).alias("y_end"), at(start).alias("cell"))
    after = (F.col("x_start") < F.col("y_start")) | ((F.col("x_start") == F.col("y_start")) & (F.col("x") < F.col("y")))
    both = first.join(later, [*pool, "cell"]).where(after & (F.col("y_start") < F.least("x_end", "y_end")))
    a, b = F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    return both.select(*pool, a, b).select(*pool, *(F.col(f"a.{k}").alias(f"a_{k}") for k in key), *(F.col(f"b.{k}").alias(f"b_{k}") for k in key))


def repeated_runs(runs: DataFrame, job: str, order: list[str], version: str, least: int) -> DataFrame:
    """JOB-05: the longest series of consecutive runs on an unchanged input."""
    same = previous(version, [job], order) == F.col(version)
    found = islands(runs, [job], order, same).groupBy(job, "island").agg(F.count("*").alias("n"))
    return found.groupBy(job).agg(F.max("n").alias("longest"), F.sum("n").alias("runs")).withColumn("status", F.when(F.col("longest") >= least, "detected").otherwise("clean"))


def no_decoupling(arrivals: DataFrame, queue: str, slot: Column, failed: Column, ratio: float) -> DataFrame:
    """JOB-06: arrivals that peak far above their mean where some failed."""
    per = arrivals.groupBy(queue, slot.alias("slot")).agg(F.count("*").alias("n"), F.bool_or(failed).alias("failed"))
    agg = per.groupBy(queue).agg(F.max("n").alias("peak"), F.round(F.avg("n"), 4).alias("mean"), F.bool_or("failed").alias("failed"))
    return agg.withColumn("status", F.when((F.col("peak") >= ratio * F.col("mean")) & F.col("failed"), "detected").otherwise("clean"))


def latest_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order: duplicate ids keep one record."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
