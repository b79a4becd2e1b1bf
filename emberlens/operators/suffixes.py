"""Which repository file a path means: equality, or one ending with the other at a folder's edge, where only one file fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def url_path(url: Column) -> Column:
    """The path of a URL without its leading slashes, query, fragment and parameters' semicolon part of the last segment."""
    rest = F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1), r";[^/]*$", "")
    return F.ltrim(rest, F.lit("/"))


def suffixes(path: Column) -> Column:
    """``a/b/c``, ``b/c`` and ``c`` of ``a/b/c``."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def unique_files(paths: DataFrame, path: str, files: DataFrame, file: str) -> DataFrame:
    """``paths`` plus ``fits``, the number of files that fit, and ``file``, the one that does where it is the only one.

    Files are summed by suffix first, so a path such as ``index.js`` that ends thousands of files meets one row; a path's own
    suffixes meet whole files, of which there is one each. So no join has more rows than paths have folders. Paths meet as
    hashes and are then compared."""
    there = files.select(F.col(file).alias("_f")).where("_f != ''").distinct()
    ends = there.select("_f", F.explode(suffixes(F.col("_f"))).alias("_s")).groupBy("_s").agg(F.count("*").alias("_n"), F.min("_f").alias("_file"))
    ends = ends.withColumn("_h", F.xxhash64("_s"))
    own = paths.select(F.col(path).alias("_p")).where("_p != ''").distinct()
    shorter = own.withColumn("_h", F.xxhash64("_p")).join(ends, "_h").where("_p = _s").select("_p", "_n", "_file")
    tails = own.select("_p", F.explode(suffixes(F.col("_p"))).alias("_s")).where("_s != _p").withColumn("_h", F.xxhash64("_s"))
    longer = tails.join(there.withColumn("_h", F.xxhash64("_f")), "_h").where("_s = _f").select("_p", F.lit(1).cast("long").alias("_n"), F.col("_f").alias("_file"))
    fits = shorter.unionByName(longer).groupBy("_p").agg(F.sum("_n").alias("fits"), F.min("_file").alias("_one"))
    out = paths.join(fits, paths[path] == fits["_p"], "left")
    return out.select(*(paths[c] for c in paths.columns), F.coalesce("fits", F.lit(0)).cast("long").alias("fits"), F.when(F.col("fits") == 1, F.col("_one")).alias("file"))


def scope_keys(urls: DataFrame, url: str, files: DataFrame, file: str) -> DataFrame:
    """Distinct URLs with their scope: the one file that fits, or ``page:/`` and the path."""
    rows = urls.select(F.col(url)).distinct().withColumn("_path", url_path(F.col(url)))
    out = unique_files(rows, "_path", files, file)
    return out.select(url, "fits", F.coalesce("file", F.concat(F.lit("page:/"), F.col("_path"))).alias("scope_key"))
