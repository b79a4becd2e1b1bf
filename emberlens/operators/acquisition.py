"""Acquisition of events through a reader that gives a limited number of rows: halving of time ranges, and conflicting copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READ, SPLIT, CUT = "complete", "split", "truncated"


def halving_plan(rows: DataFrame, group: list[str], at: str, begin: str, end: str, limit: int, depth: int = 3) -> DataFrame:
    """The reads of each group's range [begin, end): level, since, until, the rows there, and whether the read is complete, split or truncated.

    A read that reaches ``limit`` rows is split at the middle, down to ``depth`` levels or ranges of one unit. All reads are planned
    from one histogram: each row finds its finest range by arithmetic, partial counts meet at most ``2 ** depth`` of these a
    group, and coarser ranges are their sums. at, begin and end are whole numbers, equal over a group for the last two."""
    inside = rows.where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).withColumns({"_low": F.col(begin), "_high": F.col(end), "_path": F.lit(1)})
    for _ in range(depth):
        # a column for each step: expressions in expressions would double in size with each level
        inside = inside.withColumns({"_mid": F.floor((F.col("_low") + F.col("_high")) / 2).cast("long"), "_wide": F.col("_high") - F.col("_low") > 1}).withColumn("_right", F.col(at) >= F.col("_mid"))
        inside = inside.withColumns({
            "_path": F.when(F.col("_wide"), F.col("_path") * 2 + F.col("_right").cast("int")).otherwise(F.col("_path")),
            "_low": F.when(F.col("_wide") & F.col("_right"), F.col("_mid")).otherwise(F.col("_low")), "_high": F.when(F.col("_wide") & ~F.col("_right"), F.col("_mid")).otherwise(F.col("_high")),
        })
    cells = inside.groupBy(*group, begin, end, "_path").agg(F.count("*").alias("_n"))
    every = cells.select(*group, begin, end, "_n", F.explode(_above("_path", depth)).alias("_node"))
    counts = every.groupBy(*group, begin, end, "_node").agg(F.sum("_n").alias("rows"))
    # ranges are made from the groups, as a read without rows is a read too
    heads = rows.select(*group, begin, end).distinct().withColumn("_node", F.explode(F.sequence(F.lit(1), F.lit((1 << depth + 1) - 1))))
    nodes = heads.withColumns({"level": F.floor(F.log2("_node")).cast("int"), "since": F.col(begin), "until": F.col(end), "_real": F.lit(True)})
    for k in range(depth):
        nodes = nodes.withColumns({"_mid": F.floor((F.col("since") + F.col("until")) / 2).cast("long"), "_wide": F.col("until") - F.col("since") > 1, "_goes": F.col("level") > k, "_bit": F.expr(f"shiftright(_node, level - {k + 1}) & 1 = 1")})
        nodes = nodes.withColumns({
            "_real": F.col("_real") & (~F.col("_goes") | F.col("_wide")),
            "since": F.when(F.col("_goes") & F.col("_bit"), F.col("_mid")).otherwise(F.col("since")), "until": F.when(F.col("_goes") & ~F.col("_bit"), F.col("_mid")).otherwise(F.col("until")),
        })
    nodes = nodes.where("_real").select(*group, "_node", "level", "since", "until")
    counted = nodes.join(counts.drop(begin, end), [*group, "_node"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    above = counted.select(*group, F.col("_node").alias("_up"), F.col("rows").alias("_over"))
    run = counted.withColumn("_up", F.shiftright("_node", 1)).join(above, [*group, "_up"], "left").where((F.col("_node") == 1) | (F.col("_over") >= limit))
    state = F.when(F.col("rows") < limit, READ).when((F.col("level") == depth) | (F.col("until") - F.col("since") <= 1), CUT).otherwise(SPLIT)
    return run.select(*group, "level", "since", "until", "rows", state.alias("state"))


def _above(path: str, depth: int):
    """A node and the nodes above it."""
    steps = F.array(*(F.shiftright(path, k) for k in range(depth + 1)))
    return F.filter(steps, lambda x: x > 0)


def coverage(plan: DataFrame, group: list[str], most_reads: int = 15) -> DataFrame:
    """Whether a group's reads certify its whole range: none truncated, and not more than may be made."""
    agg = plan.groupBy(*group).agg(F.count("*").alias("reads"), F.sum(F.when(F.col("state") == READ, F.col("rows")).otherwise(0)).alias("rows"), F.count_if(F.col("state") == CUT).alias("cut"))
    reason = F.when(F.col("cut") > 0, "truncated").when(F.col("reads") > most_reads, "too many reads")
    return agg.select(*group, "reads", "rows", reason.alias("refused"))


def distinct_events(rows: DataFrame, key: list[str], payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row for each key, and the keys whose copies differ, with the number of copies and of different ones.

    Payloads meet as digests, so a key with very many copies is counted from partial sets of different ones."""
    body = F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256)
    hashed = rows.withColumn("_body", body)
    per = hashed.groupBy(*key, "_body").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in payload))
    agg = per.groupBy(*key).agg(F.sum("_n").alias("copies"), F.count("*").alias("versions"), *(F.first(c).alias(c) for c in payload))
    return agg.where("versions = 1").select(*key, *payload, "copies"), agg.where("versions > 1").select(*key, "copies", "versions")
