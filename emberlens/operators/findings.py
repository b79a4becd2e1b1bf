"""Findings as rows: filters, order, grading, evidence checks, and links to the jobs and steps that ran a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import confidence_rank


def surfaced(findings: DataFrame, floor: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Findings above the confidence floor of their check, and how many each check hides."""
    least = F.create_map(*(F.lit(x) for kv in floor.items() for x in kv)) if floor else F.create_map().cast("map<string,string>")
    below = F.coalesce(confidence_rank(F.col("confidence")) > confidence_rank(F.try_element_at(least, F.col("check_id"))), F.lit(False))
    rows = findings.withColumn("_below", below)
    return rows.where("NOT _below").drop("_below"), rows.where("_below").groupBy("check_id").agg(F.count("*").alias("hidden"))


def filtered(findings: DataFrame, layer: str | None = None, owner: str | None = None, check: str | None = None, confidence: str | None = None, text: str | None = None) -> DataFrame:
    """Findings of one layer, owner, check or confidence whose summary or place holds a text, in any case."""
    for column, wanted in (("layer", layer), ("owner", owner), ("check_id", check), ("confidence", confidence)):
        findings = findings if wanted is None else findings.where(F.col(column) == wanted)
    return findings if not text else findings.where(F.contains(F.lower(F.concat_ws(" ", "check_id", "summary", "file")), F.lit(text.lower())))


def glob(pattern: str) -> str:
    """A glob as a regular expression over a whole name: * and ? match any characters."""
    plain = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in pattern)
    return f"^{plain}$"


def allowed(rows: DataFrame, name: Column, patterns: list[str]) -> DataFrame:
    return rows.where(name.rlike("|".join(map(glob, patterns)) or "^\\b$"))


def in_order(findings: DataFrame, place: str = "place") -> DataFrame:
    """Findings with their place in a report: confidence, check, file, line, id."""
    order = Window.partitionBy("scan").orderBy(confidence_rank(F.col("confidence")), "check_id", F.col("file").asc_nulls_first(), F.col("line").asc_nulls_first(), "id")
    return findings.withColumn(place, F.row_number().over(order))


def first_of_each(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, and how many more it has."""
    n, of = F.row_number().over(Window.partitionBy(*by).orderBy(*order)), F.count("*").over(Window.partitionBy(*by))
    return rows.withColumns({"n": n, "omitted": F.greatest(of - most, F.lit(0))}).where(F.col("n") <= most)


def graded(checks: DataFrame) -> DataFrame:
    """One grade for each check: exactly one of error, unavailable, not_applicable and result must be there."""
    kinds = ("error", "unavailable", "not_applicable", "result")
    there = F.filter(F.array(*(F.when(F.col(k).isNotNull(), F.lit(k)) for k in kinds)), lambda x: x.isNotNull())
    return checks.select("check_id", F.when(F.size(there) == 1, there[0]).otherwise("error").alias("grade"), F.when(F.size(there) != 1, F.concat(F.lit("has "), F.size(there).cast("string"), F.lit(" of four states"))).alias("problem"))


def primary_location(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """The first static evidence of each finding, null where it has none; evidence: id, n, kind, locator, line."""
    first = evidence.where("kind = 'static'").groupBy("id").agg(F.min_by(F.struct("locator", "line"), "n").alias("at"))
    return findings.join(first, "id", "left").select(*findings.columns, F.col("at.locator").alias("file"), F.col("at.line").alias("line"))


def unsupported(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence that its source does not bear out: another scope, locator or kind, or lines that differ from the source's; evidence: source_id, scope, kind, locator, line, value."""
    own = sources.select("source_id", F.col("scope").alias("_scope"), F.col("kind").alias("_kind"), F.col("locator").alias("_locator"), "content")
    rows = evidence.join(own, "source_id", "left")
    lines = F.size(F.split("value", "\n", -1))
    quoted = F.array_join(F.slice(F.split("content", "\n", -1), F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)), lines), "\n")
    reason = (
        F.when(F.col("_scope").isNull(), "no such source").when(F.col("_scope") != F.col("scope"), "other scope").when(F.col("_kind") != F.col("kind"), "other kind")
        .when(F.col("_locator") != F.col("locator"), "other place").when((F.col("kind") == "static") & (quoted != F.col("value")), "other lines").when((F.col("kind") != "static") & (F.col("content") != F.col("value")), "other value")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select(*evidence.columns, "reason")


def linked(findings: DataFrame, jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """How far each finding leads: none, workflow, job or step, with the one job or step whose lines hold it; jobs: file, job, first, last; steps: file, job, step, first, last."""
    hit = lambda spans, *names: findings.select("id", "file", "line").join(spans, "file").where("line BETWEEN first AND last").groupBy("id").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in names)).where("n = 1").drop("n")
    flows = jobs.select("file").distinct().withColumn("_flow", F.lit(True))
    rows = findings.join(flows, "file", "left").join(hit(jobs, "job"), "id", "left")
    rows = rows.join(hit(steps.select("file", F.col("job").alias("_job"), "step", "first", "last"), "_job", "step"), "id", "left")
    level = F.when(F.col("_flow").isNull(), "none").when(F.col("job").isNull(), "workflow").when(F.col("step").isNull() | (F.col("_job") != F.col("job")), "job").otherwise("step")
    return rows.select(*findings.columns, level.alias("level"), "job", F.when(level == "step", F.col("step")).alias("step"))


def energy_used(samples: DataFrame) -> DataFrame:
    """Joules of each process from running counters; a counter that falls was reset and adds nothing. samples: pid, created, at, energy."""
    w = Window.partitionBy("pid", "created").orderBy("at")
    step = F.greatest(F.col("energy") - F.lag("energy").over(w), F.lit(0.0))
    return samples.withColumn("_step", F.coalesce(step, F.lit(0.0))).groupBy("pid", "created").agg(F.sum("_step").alias("joules"), F.count("*").alias("samples"))
