"""Points in nested intervals: each interval stands in cells of the one size that fits it, so a point meets few of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed


def _level(first: str, last: str):
    """The least k for which cells of 2**k hold at least as many places as the interval has."""
    size = F.col(last) - F.col(first) + 1
    return F.when(size <= 1, 0).otherwise(F.ceil(F.log2(size.cast("double")))).cast("int")


def containing(points: DataFrame, point: str, at: str, spans: DataFrame, span: str, first: str, last: str, group: list[str], cells: bool = False) -> DataFrame:
    """point and span of each interval [first, last] of the point's group that holds it.

    An interval of n places lies in at most two cells of its level, the power of two at or above n; a point lies in one cell of
    each level that its group has. So the join is on equal (group, level, cell), and what meets there is at most four times
    as long as an interval, whatever else the group holds. Places are whole numbers, negative ones included.
    With ``cells``, the level and cell where they met are there as well, and rows are dealt by them."""
    level = _level(first, last)
    cell = lambda c, k: F.floor(c / F.pow(F.lit(2.0), k)).cast("long")
    whole = spans.where(F.col(last) >= F.col(first)).select(*group, span, F.col(first).alias("_first"), F.col(last).alias("_last"), level.alias("_level"))
    placed = whole.withColumn("_cell", F.explode(F.sequence(cell(F.col("_first"), F.col("_level")), cell(F.col("_last"), F.col("_level")))))
    levels = whole.select(*group, "_level").distinct().groupBy(*group).agg(F.collect_set("_level").alias("_levels"))  # 64 at most
    asked = points.select(*group, point, F.col(at).alias("_at")).where("_at IS NOT NULL").join(levels, group).withColumn("_level", F.explode("_levels")).withColumn("_cell", cell(F.col("_at"), F.col("_level")))
    return asked.join(placed, [*group, "_level", "_cell"]).where("_at BETWEEN _first AND _last").select(*group, point, span, "_first", "_last", *(["_level", "_cell"] if cells else []))


def innermost(points: DataFrame, point: str, at: str, spans: DataFrame, span: str, first: str, last: str, group: list[str]) -> DataFrame:
    """``points`` plus around, the number of intervals that hold each, span, the shortest of them, and alone: no other is as short.

    Where several are as short, the least name is given and alone is false."""
    found = containing(points, point, at, spans, span, first, last, group, cells=True)
    # a point meets the intervals of a level in one cell and so in one task, and those of the least level are the shortest
    cell = [*group, "_level", "_cell", point]
    per = found.groupBy(*cell, (F.col("_last") - F.col("_first")).alias("_size")).agg(F.count("*").alias("_same"), F.min(span).alias("_span"))
    per = per.groupBy(*cell).agg(F.sum("_same").alias("_around"), F.min(F.struct("_size", "_same", "_span")).alias("_b"))
    best = per.groupBy(point).agg(F.sum("_around").alias("around"), F.min("_b").alias("_b"))
    out = points.join(best, point, "left")
    return out.select(*points.columns, F.coalesce("around", F.lit(0)).cast("long").alias("around"), F.col("_b._span").alias(span), (F.col("_b._same") == 1).alias("alone"))


def linked_findings(findings: DataFrame, jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """How far each finding (id, file, line) leads: none, workflow, job or step.

    jobs: file, job, first, last; steps: file, job, step, first, last. A job counts where it is the only one around the line, and a
    step where it is the only one of that job."""
    flows = jobs.select("file").distinct().withColumn("_flow", F.lit(True))
    alone = lambda found, name: found.groupBy("id").agg(F.count("*").alias("_n"), F.min(name).alias(name)).where("_n = 1").drop("_n")
    job = checkpointed(alone(containing(findings, "id", "line", jobs, "job", "first", "last", ["file"]), "job"))
    of_job = findings.select("id", "file", "line").join(job, "id")
    step = alone(containing(of_job, "id", "line", steps, "step", "first", "last", ["file", "job"]), "step")
    rows = findings.join(flows, "file", "left").join(job, "id", "left").join(step, "id", "left")
    level = F.when(F.col("_flow").isNull(), "none").when(F.col("job").isNull(), "workflow").when(F.col("step").isNull(), "job").otherwise("step")
    return rows.select(*findings.columns, level.alias("level"), "job", "step")
