"""A read and the later read of the same request: an interval join of two streams, or of two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlated(firsts: DataFrame, seconds: DataFrame, same: list[str], seconds_within: int, id_: str = "id", at: str = "at") -> DataFrame:
    """Each first read with every second one of the same request that follows within the time, or with none.

    Both: ``same``, id and at; for streams at has a watermark. Results: ``same``, first_id, first_at, second_id, second_at.
    Time is cut into cells as long as the interval: a pair lies in a cell or in two neighbours, so a request with very many
    reads is spread over its cells. On streams the interval bounds how long state is kept, and a first read without a second is
    given once the watermark has passed its interval."""
    step = F.unix_seconds(F.col(at).cast("timestamp"))
    cell = F.floor(step / seconds_within).cast("long")
    a = firsts.select(*(F.col(c).alias(f"_{c}") for c in same), F.col(id_).alias("first_id"), F.col(at).alias("first_at"), cell.alias("_cell"))
    b = seconds.select(*same, F.col(id_).alias("second_id"), F.col(at).alias("second_at"), F.explode(F.array(cell, cell - 1)).alias("_of"))
    on = [F.col(f"_{c}") == F.col(c) for c in same] + [F.col("_cell") == F.col("_of"), F.col("second_at") > F.col("first_at"), F.col("second_at") <= F.col("first_at") + F.expr(f"INTERVAL {seconds_within} SECONDS")]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return a.join(b, condition, "left_outer").select(*(F.col(f"_{c}").alias(c) for c in same), "first_id", "first_at", "second_id", "second_at")


def dead_reads(pairs: DataFrame, used: DataFrame, key: str = "first_id") -> DataFrame:
    """DB-05: reads whose result nothing used (``used``: id) before a second read replaced it; reads without a second one are clean."""
    per = pairs.groupBy(key).agg(F.count("second_id").alias("later"), F.min("second_at").alias("replaced_at"))
    out = per.join(used.select(F.col("id").alias(key)).distinct().withColumn("_used", F.lit(True)), key, "left")
    return out.select(key, "later", "replaced_at", F.when((F.col("later") > 0) & F.col("_used").isNull(), "detected").otherwise("clean").alias("status"))
