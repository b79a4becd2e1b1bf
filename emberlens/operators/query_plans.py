"""EXPLAIN (FORMAT JSON) plans: a node table, flattened without Python, and the rules on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed

FIELDS = {
    "node_type": ("Node Type", "string"), "relation": ("Relation Name", "string"), "filter": ("Filter", "string"), "actual_rows": ("Actual Rows", "double"),
    "loops": ("Actual Loops", "double"), "removed": ("Rows Removed by Filter", "double"), "sort_key": ("Sort Key", "string"), "space_kb": ("Sort Space Used", "double"),
    "space_type": ("Sort Space Type", "string"), "relationship": ("Parent Relationship", "string"),
}


def nodes(plans: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each node: key, node (its path), parent and the fields that rules read; malformed plans give none.

    Levels are unrolled one at a time over variants, whose schema may recurse, each from a checkpoint of its own."""
    root = plans.select(key, F.lit("0").alias("node"), F.lit(None).cast("string").alias("parent"), F.expr(f"try_variant_get(try_parse_json(`{text}`), '$[0].Plan', 'variant')").alias("v")).where("v IS NOT NULL")
    out = None
    while True:
        fields = [F.expr(f"try_variant_get(v, '$[\"{name}\"]', '{kind}')").alias(c) for c, (name, kind) in FIELDS.items()]
        part = root.select(key, "node", "parent", *fields)
        out = part if out is None else out.unionByName(part)
        numbered = checkpointed(root.select(key, "node", F.posexplode(F.expr("try_variant_get(v, '$.Plans', 'array<variant>')")).alias("i", "v")))
        if numbered.isEmpty():
            return out
        root = numbered.select(key, F.concat_ws(".", "node", F.col("i").cast("string")).alias("child"), F.col("node").alias("parent"), "v").withColumnRenamed("child", "node")


def wasteful_scans(table: DataFrame, key: str, min_rows: float, min_removed: float) -> DataFrame:
    """DB-43: filtered sequential scans that examine many rows and drop most."""
    rows = table.where("node_type = 'Seq Scan' AND filter IS NOT NULL")
    examined = (F.col("actual_rows") + F.coalesce("removed", F.lit(0.0))) * F.col("loops")
    rows = rows.select(key, "node", "relation", examined.alias("examined"), (F.col("removed") * F.col("loops") / F.nullif(examined, F.lit(0.0))).alias("removed_share"))
    return rows.where((F.col("examined") >= min_rows) & (F.col("removed_share") >= min_removed))


def disk_sorts(table: DataFrame, key: str, min_kb: float) -> DataFrame:
    """DB-45: sorts that went to disk."""
    return table.where("node_type = 'Sort' AND space_type = 'Disk'").where(F.col("space_kb") >= min_kb).select(key, "node", "space_kb")


def inner_scans(table: DataFrame, key: str, min_loops: float, min_rows: float) -> DataFrame:
    """DB-46: sequential scans that a nested loop repeats as its direct inner child."""
    loops = table.where("node_type = 'Nested Loop'").select(F.col(key), F.col("node").alias("parent"))
    inner = table.where("node_type = 'Seq Scan' AND relationship = 'Inner'").where((F.col("loops") >= min_loops) & (F.col("actual_rows") + F.coalesce("removed", F.lit(0.0)) >= min_rows))
    return inner.join(loops, [key, "parent"], "left_semi").select(key, "node", "relation", "loops")
