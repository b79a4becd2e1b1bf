"""Pages and prompts: elements of page trees, repeated sentences and static prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences

# Classes that lazy-loading libraries look for, and values that leave a style's size open.
LAZY_CLASSES = ("lazyload", "lozad", "lazy")
UNSET = ("auto", "initial", "unset", "inherit", "")


def shape(nodes: DataFrame, key: str, most: int = 1400) -> DataFrame:
    """FE-16: elements of each page, the depth of the deepest and the most children of one."""
    children = nodes.groupBy(key, "parent").agg(F.count("*").alias("_c"), F.max("depth").alias("_d"))
    out = children.groupBy(key).agg(F.sum("_c").alias("elements"), (F.max("_d") + 1).alias("max_depth"), F.max(F.when(F.col("parent").isNotNull(), F.col("_c")).otherwise(0)).alias("most_children"))
    return out.withColumn("status", F.when(F.col("elements") > most, "detected").otherwise("clean"))


def style_value(style: Column, name: str) -> Column:
    """The last value of a property in a style attribute, lower-cased; ``auto`` where there is none."""
    named = F.filter(F.split(F.lower(F.coalesce(style, F.lit(""))), ";"), lambda p: p.contains(":") & (F.trim(F.substring_index(p, ":", 1)) == name))
    value = F.try_element_at(named, F.lit(-1))
    return F.coalesce(F.trim(F.substr(value, F.position(F.lit(":"), value) + 1)), F.lit("auto"))


def unsized(nodes: DataFrame, key: str) -> DataFrame:
    """FE-03: each image of a page: exempt, sized, or bare, then with low confidence where a style sheet may size it.

    Two of width, height and aspect ratio size an image; a template's placeholder is a size."""
    attr = lambda name: F.col("attrs")[name]
    given = lambda name: F.coalesce(attr(name).rlike(r"\{\{|\{%|<%|\$\{") | attr(name).rlike(r"^\s*[0-9]"), F.lit(False)) | ~style_value(attr("style"), name).isin(*UNSET)
    width, height, ratio = given("width"), given("height"), ~style_value(attr("style"), "aspect-ratio").isin(*UNSET)
    exempt = F.lower(F.trim(F.coalesce(attr("src"), F.lit("")))).startswith("data:image/svg+xml") | F.coalesce(F.lower(attr("style")).rlike(r"position\s*:\s*(fixed|absolute)"), F.lit(False))
    verdict = F.when(exempt, "exempt").when((width & height) | (width & ratio) | (height & ratio), "sized").otherwise("bare")
    low = F.map_contains_key("attrs", F.lit("class")) | F.map_contains_key("attrs", F.lit("id"))
    out = nodes.where("name = 'img'").select(key, "n", attr("src").alias("src"), verdict.alias("verdict"), low.alias("low"))
    return out.withColumn("confidence", F.when(F.col("verdict") == "bare", F.when(F.col("low"), "low").otherwise("medium"))).drop("low")


def images_without_size(pages: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """FE-03 by page, pages without images included."""
    agg = unsized(nodes, key).groupBy(key).agg(F.count("*").alias("images"), F.count_if(F.col("verdict") == "bare").alias("bare"), F.count_if(F.col("confidence") == "medium").alias("sure"))
    out = pages.select(key).join(agg, key, "left").na.fill(0, ["images", "bare", "sure"])
    return out.withColumn("status", F.when(F.col("bare") > 0, "detected").otherwise("clean"))


def lazy_images(nodes: DataFrame, key: str) -> DataFrame:
    """FE-04: images that a library loads late although browsers can: a library's class and a data-src, and no loading=lazy."""
    words = F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+")
    hit = F.arrays_overlap(words, F.array(*(F.lit(c) for c in LAZY_CLASSES))) & F.col("attrs")["data-src"].isNotNull() & (F.lower(F.coalesce(F.col("attrs")["loading"], F.lit(""))) != "lazy")
    return nodes.where("name = 'img'").where(hit).select(key, "n", F.col("attrs")["data-src"].alias("data_src"))


def library_scripts(nodes: DataFrame, key: str, names: tuple[str, ...] = ("lazysizes", "vanilla-lazyload", "lozad", "react-lazyload")) -> DataFrame:
    """FE-04: script elements whose source names a lazy-loading library."""
    src = F.lower(F.col("attrs")["src"])
    library = F.coalesce(*(F.when(src.contains(x), F.lit(x)) for x in names))
    return nodes.where("name = 'script'").select(key, "n", library.alias("library")).where("library IS NOT NULL")


def repeated_sentences(prompts: DataFrame, key: str, text: str, least_chars: int = 40) -> DataFrame:
    """LLM-03: sentences of a prompt that say again what it said, normalised."""
    rows = prompts.select(key, F.explode(sentences(F.col(text))).alias("s")).where(F.length("s") >= least_chars)
    counts = rows.groupBy(key, "s").agg(F.count("*").alias("n")).where("n > 1")
    return counts.groupBy(key).agg(F.count("*").alias("sentences"), F.sum(F.col("n") - 1).alias("repeats"), F.sum((F.col("n") - 1) * F.length("s")).cast("long").alias("chars"))


def prefix_tokens(prompts: DataFrame, by: str, text: str, n_chars: int, least_tokens: float) -> DataFrame:
    """LLM-01: first n characters that several prompts of a group share, and the tokens sent again for them."""
    rows = prompts.where(F.length(text) >= n_chars).select(by, F.substring(text, 1, n_chars).alias("prefix"))
    counts = rows.groupBy(by, "prefix").agg(F.count("*").alias("n")).where("n > 1")
    out = counts.groupBy(by).agg(F.count("*").alias("prefixes"), F.sum("n").alias("prompts"), (F.sum(F.col("n") - 1) * n_chars / 4.0).alias("tokens_again"))
    return out.withColumn("status", F.when(F.col("tokens_again") >= least_tokens, "detected").otherwise("clean"))
