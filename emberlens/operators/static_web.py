"""Scripts, style sheets and page sources by plain patterns: what needs a parser is not judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Properties whose change lays out or paints the page again.
LAYOUT = ("width", "height", "top", "left", "right", "bottom", "margin", "padding", "font-size", "border-width", "all")


def _without_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "/[*](?:[^*]|[*](?!/))*[*]/", " "), "(^|[^:])//[^\n]*", "$1")


def layout_transitions(files: DataFrame) -> DataFrame:
    """FE-17: transitions of properties that lay out again, one row for each declaration and property."""
    css = files.where(F.col("path").rlike("[.](css|scss|less)$")).select("path", _without_comments(F.col("text")).alias("t"))
    rows = css.select("path", F.explode(F.regexp_extract_all("t", F.lit("transition(?:-property)?[ ]*:[ ]*([^;}]*)"), F.lit(1))).alias("value"))
    names = rows.select("path", F.explode(F.transform(F.split("value", ","), lambda x: F.lower(F.regexp_extract(x, "^[ \t\r\n]*([a-zA-Z-]+)", 1)))).alias("property"))
    return names.where(F.col("property").isin(*LAYOUT)).groupBy("path", "property").agg(F.count("*").alias("declarations"))


def uncleared(files: DataFrame) -> DataFrame:
    """JS-06: listeners and intervals that a component file starts and never ends."""
    js = files.where(F.col("path").rlike("[.](jsx?|tsx?|mjs|vue)$")).select("path", _without_comments(F.col("text")).alias("t"))
    n = lambda p: F.regexp_count("t", F.lit(p))
    counts = js.select("path", n("addEventListener[(]").alias("added"), n("removeEventListener[(]|[{][^}]*(once|signal)[ ]*:").alias("removed"), n("setInterval[(]").alias("started"), n("clearInterval[(]").alias("stopped"))
    return counts.where("(added > 0 AND removed = 0) OR (started > 0 AND stopped = 0)")


def local_throws(files: DataFrame) -> DataFrame:
    """JS-09: a throw whose try block catches it right away."""
    js = files.where(F.col("path").rlike("[.](jsx?|tsx?|mjs)$")).select("path", _without_comments(F.col("text")).alias("t"))
    return js.select("path", F.regexp_count("t", F.lit("try[ ]*[{][^{}]*throw [^{}]*[}][ \n]*catch")).alias("throws")).where("throws > 0")


def overlapping_tools(manifests: DataFrame, categories: dict[str, str]) -> DataFrame:
    """OBS-15: two or more distinct tools of one category in a package; manifests: path, name."""
    table = F.create_map(*(F.lit(x) for kv in categories.items() for x in kv))
    rows = manifests.select("path", "name", F.try_element_at(table, F.col("name")).alias("category")).where("category IS NOT NULL")
    return rows.groupBy("path", "category").agg(F.array_sort(F.collect_set("name")).alias("tools")).where(F.size("tools") > 1)


def field_drift(fields: DataFrame, scope: str, concept: str, spelling: str, file: str) -> DataFrame:
    """OBS-18: concepts that a project's logs spell in several ways; the reference is the most used, snake case first, then by name."""
    counts = fields.groupBy(scope, concept, spelling).agg(F.count("*").alias("n"), F.countDistinct(file).alias("files"))
    snake = F.when(F.col(spelling).rlike("^[a-z0-9]+(_[a-z0-9]+)*$"), 0).otherwise(1)
    order = F.struct(-F.col("n"), snake, F.col(spelling))
    agg = counts.groupBy(scope, concept).agg(F.count("*").alias("spellings"), F.min_by(spelling, order).alias("reference"), F.sum("n").alias("uses"))
    return agg.where("spellings > 1")


def concept(key: Column) -> Column:
    """camelCase, kebab-case and snake_case of one name are one concept."""
    return F.lower(F.regexp_replace(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_"))


def end_of_life(files: DataFrame, support: DataFrame, reference_date: str, warn_days: int = 180) -> DataFrame:
    """CODE-RT.6: runtimes that configuration pins and whose support has ended or soon will; support: runtime, version, ends."""
    pins = F.regexp_extract_all("text", F.lit("(?m)((?:python|node|ruby|golang|php)[:=-]?[ ]?[0-9]+(?:[.][0-9]+)?)"), F.lit(1))
    rows = files.select("path", F.explode(F.array_distinct(pins)).alias("pin"))
    split = rows.select("path", F.regexp_extract("pin", "^([a-z]+)", 1).alias("runtime"), F.regexp_extract("pin", "([0-9]+(?:[.][0-9]+)?)$", 1).alias("version"))
    days = F.datediff("ends", F.lit(reference_date).cast("date"))
    return split.join(F.broadcast(support), ["runtime", "version"]).withColumn("days_left", days).where(F.col("days_left") <= warn_days)
