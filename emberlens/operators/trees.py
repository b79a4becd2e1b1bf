"""Trees as relations: sums over whole subtrees by intervals or by doubling, and what calls of a profile own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from .traces import nearest_ancestor


def subtree_by_interval(nodes: DataFrame, tree: str, weight: str, total: str) -> DataFrame:
    """``nodes`` plus the sum of ``weight`` over each subtree. nodes: tree, n (in pre-order) and last, the last n of the subtree.

    A subtree is an interval of running sums: one sort by tree and n, one equi-join with where subtrees end."""
    upto = F.sum(weight).over(Window.partitionBy(tree).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    sums = nodes.withColumn("_upto", upto)
    ends = sums.select(F.col(tree).alias("_t"), F.col("n").alias("_n"), F.col("_upto").alias("_end"))
    joined = sums.join(ends, sums[tree].eqNullSafe(F.col("_t")) & (F.col("last") == F.col("_n")))
    return joined.withColumn(total, F.col("_end") - F.col("_upto") + F.col(weight)).drop("_t", "_n", "_end", "_upto")


def subtree_by_doubling(nodes: DataFrame, key: list[str], parent: str, weight: str, total: str) -> DataFrame:
    """``nodes`` plus the sum of ``weight`` over each subtree, from parent pointers alone; ``key``: leading columns and the node's id.

    After round k a node holds the sum of what stands fewer than 2**k levels below it, and points 2**k levels up: it
    passes its sum there and doubles its pointer. So log2 of the depth rounds suffice, and a chain of a million nodes takes 20.
    Nodes on a cycle of parents, and those below, have no sum: their pointers still run after log2 of the nodes rounds."""
    *group, last = key
    state = checkpointed(nodes.select(*key, F.col(parent).alias("_up"), F.col(weight).alias("_sum")))
    # a parent that is not there is none
    ids = state.select(*group, F.col(last).alias("_up"), F.lit(True).alias("_there"))
    state = checkpointed(state.join(ids, [*group, "_up"], "left").select(*key, F.when(F.col("_there"), F.col("_up")).alias("_up"), "_sum"))
    rounds = (state.groupBy(*group).count().agg(F.max("count").alias("n")).first().n if group else state.count()) or 0
    for _ in range(int(rounds).bit_length() + 1):
        if state.where("_up IS NOT NULL").isEmpty():
            break
        passed = state.where("_up IS NOT NULL").groupBy(*group, F.col("_up").alias(last)).agg(F.sum("_sum").alias("_more"))
        above = state.select(*group, F.col(last).alias("_up"), F.col("_up").alias("_next"))
        state = state.join(passed, key, "left").join(above, [*group, "_up"], "left")
        state = checkpointed(state.select(*key, F.col("_next").alias("_up"), (F.col("_sum") + F.coalesce("_more", F.lit(0))).alias("_sum")))
    # sums of nodes whose subtree holds a cycle never end; everything on or below one still has a pointer
    return nodes.join(state.select(*key, F.when(F.col("_up").isNull(), F.col("_sum")).alias(total)), key, "left")


def owned_bytes(frames: DataFrame, key: list[str], parent: str, url: Column, module: Column, place: list[str], size: str, least: int) -> DataFrame:
    """Allocated bytes by place of heap profiles: what frames without a URL allocate counts for the nearest caller with one.

    Frames of modules own nothing, and what is called from them neither; places under ``least`` bytes are left out."""
    tree, node = key
    rows = frames.withColumns({"_named": url.isNotNull() & (url != ""), "_module": module})
    owned = nearest_ancestor(rows, F.col("_named"), tree, node, parent).select(tree, node, "owner", F.col(size).alias("_size"))
    owners = rows.where(F.col("_named") & ~F.col("_module")).select(F.col(tree).alias("_t"), F.col(node).alias("_n"), *place)
    credited = owned.where("_size > 0 AND owner IS NOT NULL").join(owners, (F.col(tree) == F.col("_t")) & (F.col("owner") == F.col("_n")))
    return credited.groupBy(tree, *place).agg(F.sum("_size").alias("allocated_bytes")).where(F.col("allocated_bytes") >= least)
