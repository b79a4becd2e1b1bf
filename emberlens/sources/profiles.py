"""Profiler files as weighted stacks or bytes by line, read from JSON text with Spark's own functions; callers are climbed in Python."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

SPEEDSCOPE = "STRUCT<shared: STRUCT<frames: ARRAY<STRUCT<name: STRING, file: STRING, line: BIGINT>>>, profiles: ARRAY<STRUCT<type: STRING, samples: ARRAY<ARRAY<INT>>, weights: ARRAY<DOUBLE>>>>"
CPUPROFILE = "STRUCT<nodes: ARRAY<STRUCT<id: BIGINT, callFrame: STRUCT<functionName: STRING, url: STRING, lineNumber: BIGINT>, children: ARRAY<BIGINT>, hitCount: BIGINT>>, samples: ARRAY<BIGINT>>"
MEMRAY = "STRUCT<total_num_allocations: BIGINT, total_bytes_allocated: BIGINT, top_allocations_by_size: ARRAY<STRUCT<location: STRING, size: BIGINT>>, top_allocations_by_count: ARRAY<STRUCT<location: STRING, count: BIGINT>>, metadata: STRUCT<peak_memory: BIGINT>>"


def speedscope(raw: DataFrame, profile: str, text: str) -> DataFrame:
    """(profile, part, frames from root to leaf as struct(name, file, line), weight) of every sampled stack."""
    doc = raw.select(profile, F.from_json(text, SPEEDSCOPE).alias("d")).where("d IS NOT NULL")
    parts = doc.select(profile, F.col("d.shared.frames").alias("f"), F.posexplode("d.profiles").alias("part", "p")).where("p.type = 'sampled'")
    samples = parts.select(profile, "part", "f", F.explode(F.arrays_zip(F.col("p.samples").alias("samples"), F.col("p.weights").alias("weights"))).alias("s"))
    frames = F.transform("s.samples", lambda i: F.get("f", i))
    return samples.select(profile, "part", frames.alias("frames"), F.coalesce("s.weights", F.lit(0.0)).alias("weight")).where("weight > 0")


def line_shares(stacks: DataFrame, profile: str, least: float = 0.01) -> DataFrame:
    """Share of the sampled time that each line was on the stack, once a sample."""
    total = stacks.groupBy(profile).agg(F.sum("weight").alias("total"))
    lines = stacks.select(profile, "weight", F.explode(F.array_distinct(F.transform("frames", lambda f: F.struct(f["file"].alias("file"), f["line"].alias("line"))))).alias("l"))
    agg = lines.groupBy(profile, F.col("l.file").alias("file"), F.col("l.line").alias("line")).agg(F.sum("weight").alias("weight"))
    return agg.join(total, profile).withColumn("share", F.col("weight") / F.col("total")).where(F.col("share") >= least)


def _climbs(ids: list, children: list, samples: list) -> list[tuple[int, list[int]]]:
    """Each sampled node with itself and all its callers, however deep; a node is taken once, so cycles end."""
    parents: dict[int, list[int]] = {}
    for node, below in zip(ids or [], children or [], strict=True):
        for child in below or []:
            parents.setdefault(child, []).append(node)
    out = []
    for sample in set(samples or []):
        stack, todo = {sample}, [sample]
        while todo:
            fresh = [p for p in parents.get(todo.pop(), []) if p not in stack]
            stack.update(fresh)
            todo += fresh
        out.append((sample, list(stack)))
    return out


def _climbed(ids: pa.Array, children: pa.Array, samples: pa.Array) -> pa.Array:
    rows = [[{"sample": n, "stack": stack} for n, stack in _climbs(*row)] if None not in row else None for row in zip(*(c.to_pylist() for c in (ids, children, samples)), strict=True)]
    return pa.array(rows, pa.list_(pa.struct([("sample", pa.int64()), ("stack", pa.list_(pa.int64()))])))


def cpuprofile(raw: DataFrame, profile: str, text: str) -> DataFrame:
    """V8 CPU profiles: busy samples by function, self and inclusive (once a sample), idle samples left out.

    Parents come from the children lists; a sample's ancestors are found once for each node, by following parents."""
    doc = raw.select(profile, F.from_json(text, CPUPROFILE).alias("d")).where("d IS NOT NULL")
    nodes = doc.select(profile, F.explode("d.nodes").alias("n")).select(profile, F.col("n.id").alias("id"), F.col("n.callFrame.functionName").alias("function"), F.col("n.callFrame.url").alias("url"), F.col("n.callFrame.lineNumber").alias("line"), F.col("n.children").alias("children"))
    hits = doc.select(profile, F.explode("d.samples").alias("id")).groupBy(profile, "id").agg(F.count("*").alias("n"))
    busy = hits.join(nodes.where("function NOT IN ('(idle)', '(program)')").select(profile, "id"), [profile, "id"]).select(profile, F.col("id").alias("sample"), "id", "n")
    climb = arrow_udf(_climbed, "array<struct<sample: bigint, stack: array<bigint>>>")
    stacks = doc.select(profile, F.explode(climb("d.nodes.id", "d.nodes.children", "d.samples")).alias("c")).select(profile, "c.sample", F.explode("c.stack").alias("id"))
    chain = busy.drop("id").join(stacks, [profile, "sample"])
    own = F.sum(F.when(F.col("id") == F.col("sample"), F.col("n")).otherwise(0)).alias("self")
    by = [profile, "function", "url", "line"]
    placed = chain.join(nodes.drop("children"), [profile, "id"]).groupBy(*by, "sample").agg(F.max("n").alias("n"), F.max(F.when(F.col("id") == F.col("sample"), F.col("n")).otherwise(0)).alias("own"))
    return placed.groupBy(*by).agg(F.sum("own").alias("self"), F.sum("n").alias("inclusive"))


def location(c: Column) -> list[Column]:
    """function:file:line of a memray location; file names may hold colons."""
    pattern = "^([^:]*):(.*):([0-9]+)$"
    return [F.regexp_extract(c, pattern, 1).alias("function"), F.regexp_extract(c, pattern, 2).alias("file"), F.regexp_extract(c, pattern, 3).cast("int").alias("line")]


def memray(raw: DataFrame, profile: str, text: str) -> DataFrame:
    """Bytes and counts by allocation line, with the profile's totals and peak."""
    doc = raw.select(profile, F.from_json(text, MEMRAY).alias("d")).where("d IS NOT NULL")
    size = doc.select(profile, F.explode("d.top_allocations_by_size").alias("a")).groupBy(profile, F.col("a.location").alias("location")).agg(F.sum("a.size").alias("bytes"))
    count = doc.select(profile, F.explode("d.top_allocations_by_count").alias("a")).groupBy(profile, F.col("a.location").alias("location")).agg(F.sum("a.count").alias("n"))
    facts = doc.select(profile, F.col("d.total_bytes_allocated").alias("total_bytes"), F.col("d.metadata.peak_memory").alias("peak_bytes"))
    both = size.join(count, [profile, "location"], "full").join(facts, profile)
    return both.where(F.col("location").rlike(":[0-9]+$")).select(profile, *location(F.col("location")), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n"), "total_bytes", "peak_bytes")
