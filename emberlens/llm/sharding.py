"""Proportional stratified interleaving: every shard gets the mixture of sources that the whole table has.

Rows are shuffled by a seeded hash and ranked within their source; the r-th of n rows stands at (r + 1/2) / n, and the
order of these fractions is cut into shards whose row counts differ by one at most. Both rankings are range-partitioned
sorts over narrow rows, so a source with a third of the rows is spread over many tasks like any other.

Defined results: a null text counts as empty, a null source is a source of its own, equal texts and repeated rows stay
separate rows, an empty table gives an empty result, a shard may stay empty with fewer rows than shards. Other columns
of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked

#: Sources up to this many are sent to all tasks (a few MB at most); more are joined by a sort, whose hot keys Spark splits.
MAX_BROADCAST = 1 << 15


def interleave(docs: DataFrame, shards: int, seed: int = 17, source: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, stratum, fraction, shard, slot for each row; the law is ``rows``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("stratum"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("draw"),
    )
    within = ranked(materialize(narrow, "shard-rows"), ["stratum", "draw", "doc_id", "text_crc32"], "shard-strata")
    strata = within.groupBy("stratum").agg(F.min("rank").alias("_first"), F.count("*").alias("_rows"))
    few = strata.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    placed = within.join(F.broadcast(strata) if few else strata.hint("merge"), "stratum").withColumn("fraction", (F.col("rank") - F.col("_first") + 0.5) / F.col("_rows")).drop("rank", "_first", "_rows")
    total = within.agg(F.count("*").alias("n")).first().n
    order = ranked(placed, ["fraction", "draw", "doc_id", "text_crc32"], "shard-order")
    shard = f"(((rank + 1) * {shards} - 1) DIV {max(total, 1)})"
    return order.select(
        "doc_id", "size", "text_crc32", F.expr("substring(stratum, 2)").alias("stratum"), "fraction",
        F.expr(f"CAST({shard} AS int)").alias("shard"), F.expr(f"rank - ({shard} * {total}) DIV {shards}").alias("slot"),
    )
