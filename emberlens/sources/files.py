"""Repository files as rows, with the skip rules and bounds of a scan decided by columns, and every skip counted."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Folders, files and endings that a scan leaves out.
EXCLUDED_FOLDERS = (
    ".git", ".hg", ".svn", "node_modules", "bower_components", "vendor", "third_party", "venv", ".venv", "env", "site-packages", "__pycache__", ".tox", ".nox", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", "dist", "build", ".next", ".nuxt", "coverage", "target",
)
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "composer.lock", "Cargo.lock", "uv.lock")
MINIFIED = (".min.js", ".min.css", ".map")


@dataclass(frozen=True)
class Limits:
    files: int = 5000
    file_bytes: int = 1_000_000
    total_bytes: int = 100_000_000


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative, with /) and content of every file under ``root``, by Spark's reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", f"^.*?{root.rstrip('/').lstrip('/')}/", "").alias("path"), F.col("length").alias("n_bytes"), "content")


def skip_reason(path: Column, n_bytes: Column, content: Column, limits: Limits = Limits()) -> Column:
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folder = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, EXCLUDED_FOLDERS)))
    # a byte of value zero stands at an odd place of the digits
    binary = F.hex(F.substring(content, 1, 8192)).rlike("^(..)*?00")
    return (
        F.when(folder, "excluded folder").when(name.isin(*LOCK_FILES), "lock file").when(functools.reduce(operator.or_, (name.endswith(x) for x in MINIFIED)), "minified")
        .when(n_bytes > limits.file_bytes, "too large").when(binary, "binary").when(~F.is_valid_utf8(content.cast("string")), "not UTF-8")
    )


def scan(files: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """The files to read (path, n_bytes, text) in path order within the bounds, and counts of skips by reason."""
    judged = files.withColumn("reason", skip_reason(F.col("path"), F.col("n_bytes"), F.col("content"), limits))
    # only as many paths as the bound allows meet in one task, and a running sum goes over no more
    first = judged.where("reason IS NULL").select("path", "n_bytes").orderBy("path").limit(limits.files)
    within = first.withColumn("running", F.sum("n_bytes").over(Window.orderBy("path"))).where(F.col("running") <= limits.total_bytes).select("path")
    kept = judged.where("reason IS NULL").join(within, "path", "left_semi").select("path", "n_bytes", F.col("content").cast("string").alias("text"))
    beyond = judged.where("reason IS NULL").join(within, "path", "left_anti").select(F.lit("beyond the scan's bounds").alias("reason"))
    skipped = judged.where("reason IS NOT NULL").select("reason").unionByName(beyond).groupBy("reason").agg(F.count("*").alias("n"))
    return kept, skipped


def content_sha(files: DataFrame) -> DataFrame:
    """One hash of a file set: hashes of the files, in path order."""
    rows = files.select("path", F.sha1(F.concat("path", F.lit("\0"), "text", F.lit("\0")).cast("binary")).alias("h"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "h"))), lambda x: x["h"]), "")
    return rows.agg(F.sha1(ordered.cast("binary")).alias("content_sha"), F.count("*").alias("files"))


def is_test_path(path: Column) -> Column:
    return path.rlike("(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|_test[.][a-z]+$|[.](test|spec)[.][a-z]+$")
