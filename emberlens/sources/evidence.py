"""JSON evidence: run histories, metric series, traces, profiles and log events, normalised to tidy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed

RUNS = "id BIGINT, name STRING, path STRING, event STRING, status STRING, conclusion STRING, run_attempt INT, head_sha STRING, created_at STRING, run_started_at STRING, updated_at STRING, html_url STRING"
JOBS = "run_id BIGINT, id BIGINT, name STRING, run_attempt INT, conclusion STRING, labels ARRAY<STRING>, runner_group_name STRING, created_at STRING, started_at STRING, completed_at STRING"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def timestamps(df: DataFrame, *columns: str) -> DataFrame:
    """ISO texts with a zone become timestamps; naive or malformed ones are null."""
    zoned = "(Z|[+-][0-9]{2}:?[0-9]{2})$"
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).rlike(zoned), F.try_to_timestamp(c)))
    return df


def runs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs with an id and a creation time, and the count of the others."""
    out = timestamps(raw, "created_at", "run_started_at", "updated_at")
    fine = F.col("id").isNotNull() & F.col("created_at").isNotNull()
    return out.where(fine), out.where(~fine).agg(F.count("*").alias("malformed"))


# vCPUs of hosted runner labels.
HOSTED_VCPUS = {
    "ubuntu-slim": 1,
    **dict.fromkeys(("ubuntu-latest", "ubuntu-24.04", "ubuntu-22.04", "ubuntu-26.04", "windows-latest", "windows-2025", "windows-2025-vs2026", "windows-2022"), 4),
    **dict.fromkeys(("ubuntu-24.04-arm", "ubuntu-22.04-arm", "ubuntu-26.04-arm", "windows-11-arm", "windows-11-vs2026-arm"), 4),
}
MACOS_VCPUS = {"macos-15-intel": 4, "macos-26-intel": 4, **dict.fromkeys(("macos-latest", "macos-14", "macos-15", "macos-26", "xcode-27"), 3)}


def jobs(raw: DataFrame) -> DataFrame:
    """Jobs with their kind of runner, vCPUs, seconds (floored, at least 0) and whether they count: jobs carried over from an earlier attempt start before they were created."""
    out = timestamps(raw, "created_at", "started_at", "completed_at")
    vcpus = F.create_map(*(F.lit(x) for kv in (HOSTED_VCPUS | MACOS_VCPUS).items() for x in kv))
    known = F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.map_contains_key(vcpus, x))
    own = F.array_contains("labels", "self-hosted")
    hosted = (F.col("runner_group_name") == "GitHub Actions") & (F.size(known) == 1)
    kind = F.when(own, "self-hosted").when(hosted & F.try_element_at(known, F.lit(1)).isin(*MACOS_VCPUS), "macos").when(hosted, "hosted").otherwise("unknown")
    seconds = F.greatest(F.lit(0), F.floor(F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")))
    counted = F.col("started_at").isNotNull() & F.col("completed_at").isNotNull() & ~F.coalesce(F.col("started_at") < F.col("created_at"), F.lit(False))
    return out.withColumns({"runner": kind, "vcpus": F.when(kind.isin("hosted", "macos"), F.try_element_at(vcpus, F.try_element_at(known, F.lit(1)))), "seconds": F.when(counted, seconds), "counted": counted})


def metric_series(raw: DataFrame) -> DataFrame:
    """Parallel arrays of timestamps and values as rows (resource_id, stat, ts, value), finite values only."""
    rows = raw.select("resource_id", "stat", F.explode(F.arrays_zip("timestamps", "values")).alias("p")).select("resource_id", "stat", F.col("p.timestamps").alias("ts"), F.col("p.values").alias("value"))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def collapsed_stacks(raw: DataFrame, profile: str, text: str) -> DataFrame:
    """``a;b;c 12`` lines as (profile, frames, weight); other lines are left out."""
    lines = raw.select(profile, F.explode(F.split(text, "\r?\n")).alias("line")).where(F.col("line").rlike("^.+ [0-9]+$"))
    return lines.select(profile, F.split(F.regexp_extract("line", "^(.+) [0-9]+$", 1), ";").alias("frames"), F.regexp_extract("line", " ([0-9]+)$", 1).cast("double").alias("weight"))


def segments(raw: DataFrame) -> DataFrame:
    """X-Ray segment documents (trace_id, document) as top spans; nested subsegments follow level by level, each from a checkpoint of its own."""
    v = raw.select("trace_id", F.expr("try_parse_json(document)").alias("v"))
    level, out = v.withColumn("parent", F.expr("try_variant_get(v, '$.parent_id', 'string')")), None
    while True:
        get = lambda name, kind: F.expr(f"try_variant_get(v, '$.{name}', '{kind}')")
        part = level.select("trace_id", get("id", "string").alias("span_id"), F.col("parent").alias("parent_id"), get("name", "string").alias("name"), get("namespace", "string").alias("namespace"), get("start_time", "double").alias("start_ts"), get("end_time", "double").alias("end_ts"), F.coalesce(get("in_progress", "boolean"), F.lit(False)).alias("in_progress"), (F.coalesce(get("error", "boolean"), F.lit(False)) | F.coalesce(get("fault", "boolean"), F.lit(False)) | F.coalesce(get("throttle", "boolean"), F.lit(False))).alias("failed"))
        out = part if out is None else out.unionByName(part)
        level = checkpointed(level.select("trace_id", get("id", "string").alias("parent"), F.explode(F.expr("try_variant_get(v, '$.subsegments', 'array<variant>')")).alias("v")))
        if level.isEmpty():
            return out
