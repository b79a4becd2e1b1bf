"""Reports of scans: checks with their taxonomy and grade, findings in order, limitations by reason, and a summary.

Everything is keyed by ``scan``, so many scans are assembled at once; order within a scan is a column, as tables have none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import confidence_rank
from .findings import graded

STATUSES = ("completed", "partial", "unavailable", "error", "not_applicable")
CONFIDENCES = ("high", "medium", "low")
MAX_LIMITATIONS = 12


def limitation_lines(limitations: DataFrame, most: int = MAX_LIMITATIONS) -> DataFrame:
    """scan, check_id, lines (``most`` at most) and total. limitations: scan, check_id, n (their order) and text.

    ``file:<path>: <reason>`` meets others of its reason: one file keeps its line, more give their number and the first one;
    other texts stay, behind the files. Both keep the order in which they were seen first."""
    path, reason = (F.nullif(F.regexp_extract("text", r"^file:([^:]+): ([^\n]+)$", k), F.lit("")) for k in (1, 2))
    rows = limitations.select("scan", "check_id", "n", "text", path.alias("_path"), reason.alias("_reason"))
    rows = rows.withColumn("_kind", F.when(F.col("_reason").isNull(), F.concat(F.lit("text:"), F.col("n"))).otherwise(F.replace("_reason", F.col("_path"), F.lit("<file>"))))
    per = rows.groupBy("scan", "check_id", "_kind", F.col("_reason").isNull().alias("_general")).agg(F.count("*").alias("_c"), F.min("n").alias("_n"), F.min_by(F.struct("text", "_path"), "n").alias("_first"))
    one = F.concat_ws(": ", F.col("_first._path"), F.replace("_kind", F.lit("<file>"), F.col("_first._path")))
    many = F.concat(F.col("_c"), F.lit(" files: "), F.col("_kind"), F.lit(" (e.g. "), F.col("_first._path"), F.lit(")"))
    line = F.when(F.col("_general"), F.col("_first.text")).when(F.col("_c") == 1, one).otherwise(many)
    place = F.row_number().over(Window.partitionBy("scan", "check_id").orderBy("_general", "_n"))
    kept = per.select("scan", "check_id", "_c", line.alias("_line"), place.alias("_at"))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("_at") <= most, F.struct("_at", "_line")))), lambda x: x["_line"])
    return kept.groupBy("scan", "check_id").agg(lines.alias("lines"), F.sum("_c").alias("total"))


def check_entries(runs: DataFrame, taxonomy: DataFrame, findings: DataFrame, limitations: DataFrame, rejected: DataFrame) -> DataFrame:
    """A row for each check of a scan, with its ``place`` by owner and check.

    runs: scan, check_id, owner and one of error, unavailable, not_applicable and result (a status); rejected: scan, check_id and
    problem, results that the contract refuses. taxonomy: check_id, pattern, layer; checks that it lacks stay. Findings and
    limitations of refused or missing results don't count."""
    key = ["scan", "check_id"]
    named = runs.withColumn("_key", F.to_json(F.struct(*key)))
    grade = graded(named.select(F.col("_key").alias("check_id"), "error", "unavailable", "not_applicable", "result")).select(F.col("check_id").alias("_key"), "grade", F.col("problem").alias("_states"))
    bad = rejected.groupBy(*key).agg(F.min("problem").alias("_problem"))
    # layers and patterns are as many as checks are known: joined by exchange or not, as Spark sees their size
    rows = named.join(grade, "_key").join(bad, key, "left").join(taxonomy.select("check_id", "pattern", "layer"), "check_id", "left")
    refused = (F.col("grade") == "result") & F.col("_problem").isNotNull()
    status = F.when(refused | (F.col("grade") == "error"), "error").when(F.col("grade") == "result", F.col("result")).otherwise(F.col("grade"))
    reason = F.when(refused, F.concat(F.lit("invalid detector output rejected: "), F.col("_problem"))).otherwise(F.coalesce("error", "unavailable", "not_applicable", "_states"))
    rows = rows.select(*key, "owner", "pattern", "layer", status.alias("status"), F.when((F.col("grade") == "result") & ~refused, "detector").otherwise("scanner").alias("status_source"), reason.alias("reason"))
    found = findings.groupBy(*key).agg(F.count("*").alias("_found"))
    out = rows.join(found, key, "left").join(limitation_lines(limitations), key, "left")
    own = F.col("status_source") == "detector"
    number = lambda c: F.when(own, F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast("long")
    out = out.select(*rows.columns, number("_found").alias("finding_count"), F.when(own, F.coalesce("lines", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("limitations"), number("total").alias("limitations_total"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("scan").orderBy("owner", "check_id")))


def report_findings(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings of checks whose result stands, with owner, layer and pattern, and their ``place`` by confidence, check, file, line and id."""
    kept = findings.join(entries.where("status_source = 'detector'").select("scan", "check_id", "owner", "layer", "pattern"), ["scan", "check_id"])
    order: list[Column | str] = [confidence_rank(F.col("confidence")), "check_id", F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), "id"]
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("scan").orderBy(*order)))


def summary(entries: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each scan: numbers of checks and findings by class, zeros included; layers most common first, ties as first met; owners by name."""
    zero = lambda column, values: F.map_from_entries(F.array(*(F.struct(F.lit(v), F.count_if(F.col(column) == v)) for v in values)))
    checks = entries.groupBy("scan").agg(F.count("*").alias("checks_total"), zero("status", STATUSES).alias("checks_by_status"))
    classes = found.groupBy("scan").agg(F.count("*").alias("findings_total"), zero("confidence", CONFIDENCES).alias("findings_by_confidence"))
    layers = found.groupBy("scan", "layer").agg(F.count("*").alias("n"), F.min("place").alias("p"))
    layers = layers.groupBy("scan").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "p", "layer", "n"))).alias("l"))
    layers = layers.select("scan", F.transform("l", lambda x: F.struct(x["layer"].alias("layer"), x["n"].alias("n"))).alias("findings_by_layer"))
    owners = found.groupBy("scan", "owner").agg(F.count("*").alias("n")).groupBy("scan").agg(F.array_sort(F.collect_list(F.struct("owner", "n"))).alias("findings_by_owner"))
    out = reduce(lambda a, b: a.join(b, "scan", "left"), [checks, classes, layers, owners])
    none = F.map_from_entries(F.array(*(F.struct(F.lit(v), F.lit(0).cast("long")) for v in CONFIDENCES)))
    return out.withColumns({"findings_total": F.coalesce("findings_total", F.lit(0)), "findings_by_confidence": F.coalesce("findings_by_confidence", none)})
