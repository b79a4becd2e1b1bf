"""Directed graphs: topological peeling with the longest path, and reachability from entry points.

Both walk in rounds over edges that are written once. A round touches only the rows that the last one reached, its result
goes to a reliable checkpoint, and a hub is a skewed join whose sides are plain exchanges. Rounds are as many as the
graph is deep, not as it is large."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed


def peel(nodes: DataFrame, edges: DataFrame, node: list[str], weight: str) -> DataFrame:
    """``nodes`` plus level (0 without dependencies), finish (its weight and the longest chain that it waits for) and ``blocked``.

    edges: the key columns of ``node`` and, under the names ``after_`` and the last of them, the node that it waits for, within
    the same leading columns. Blocked nodes lie on a cycle, behind one, or behind a node that is not there; their
    level and finish are null. An edge that is there twice counts once; nodes must be distinct."""
    *group, last = node
    waits = f"after_{last}"
    links = checkpointed(edges.select(*node, waits).distinct())
    left = links.groupBy(*node).agg(F.count("*").alias("_left"))
    state = nodes.select(*node, F.col(weight).alias("_w")).join(left, node, "left").select(*node, "_w", F.coalesce("_left", F.lit(0)).alias("_left"), F.lit(None).cast("double").alias("_begin"))
    state, done, level = checkpointed(state), [], 0
    while True:
        ready = state.where("_left = 0").select(*node, F.lit(level).alias("level"), (F.coalesce("_begin", F.lit(0.0)) + F.col("_w")).alias("finish"))
        ready = checkpointed(ready)
        if ready.isEmpty():
            break
        done.append(ready)
        freed = ready.select(*group, F.col(last).alias(waits), "finish").join(links, [*group, waits]).groupBy(*node).agg(F.count("*").alias("_n"), F.max("finish").alias("_m"))
        state = state.where("_left > 0").join(freed, node, "left")
        state = checkpointed(state.select(*node, "_w", (F.col("_left") - F.coalesce("_n", F.lit(0))).alias("_left"), F.greatest("_begin", "_m").alias("_begin")))
        level += 1
    found = reduce(DataFrame.unionByName, done) if done else ready
    return nodes.join(found, node, "left").withColumn("blocked", F.col("level").isNull())


def reach(edges: DataFrame, entries: DataFrame, stops: DataFrame | None = None, each: bool = False, most: int | None = None) -> DataFrame:
    """node, hops (the fewest from an entry) and entry (the least of those as near), by a frontier and the nodes seen before.

    edges: src, dst; entries: node; nodes in ``stops`` are reached but not left. With ``each``, a row for every entry that
    reaches the node; ``most`` hops at most. An entry reaches itself with 0 hops. Repeated edges and entries count once."""
    links = edges.select("src", "dst").distinct()
    if stops is not None:
        links = links.join(stops.select(F.col("node").alias("src")).distinct(), "src", "left_anti")
    links = checkpointed(links)
    key = ["entry", "node"] if each else ["node"]
    frontier = checkpointed(entries.select("node").distinct().select("node", F.lit(0).alias("hops"), F.col("node").alias("entry")))
    seen = frontier
    while most is None or most > 0:
        onward = frontier.join(links, frontier["node"] == links["src"]).select(F.col("dst").alias("node"), "hops", "entry")
        onward = onward.groupBy(*key).agg((F.min("hops") + 1).alias("hops"), *([] if each else [F.min("entry").alias("entry")]))
        frontier = checkpointed(onward.join(seen.select(*key), key, "left_anti").select("node", "hops", "entry"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        most = None if most is None else most - 1
    return seen


def cycles(edges: DataFrame, passes: int = 12) -> DataFrame:
    """node and root, the least node of its strong component, for nodes that share a cycle with another one.

    A pass gives every node the least one that reaches it; of the nodes of one such colour, those that reach the colour's
    own node are a component. Edges between colours or to settled components lie on no cycle and go, as do nodes without
    an edge in or out. What is left after ``passes`` stays apart, which a closure over the components does not mind."""
    active, found = edges.select("src", "dst").where("src != dst").distinct(), []
    for _ in range(passes):
        for _ in range(3):
            active = checkpointed(active)
            active = active.join(active.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(active.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        active = checkpointed(active)
        if active.isEmpty():
            break
        color = active.select(F.col("src").alias("node")).union(active.select("dst")).distinct().withColumn("color", F.col("node"))
        color = checkpointed(color)
        while True:
            offered = color.join(active, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("_c"))
            moved = checkpointed(color.join(offered, "node", "left").select("node", F.least("color", "_c").alias("color"), (F.col("_c") < F.col("color")).alias("_moved")))
            color = moved.select("node", "color")
            if moved.where("_moved").isEmpty():
                break
        ends = (color.select(F.col("node").alias(c), F.col("color").alias(f"_{c}")) for c in ("src", "dst"))
        within = checkpointed(reduce(lambda a, b: a.join(b, b.columns[0]), ends, active).where("_src = _dst").select("src", "dst"))
        settled = checkpointed(reach(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")), color.where("node = color")).select("node", F.col("entry").alias("root")))
        found.append(settled)
        active = within.join(settled.select(F.col("node").alias("src")), "src", "left_anti").join(settled.select(F.col("node").alias("dst")), "dst", "left_anti")
    every = reduce(DataFrame.unionByName, found) if found else edges.select(F.col("src").alias("node"), F.col("src").alias("root")).where("false")
    return every.join(every.where("node != root").select("root").distinct(), "root", "left_semi").select("node", "root")


def reached_counts(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """entry and reached: how many nodes each distinct entry reaches, itself included.

    Nodes on common cycles reach the same, so the closure runs over components with their sizes, from distinct ones."""
    links = checkpointed(edges.select("src", "dst").distinct())
    roots = checkpointed(cycles(links))
    size = roots.groupBy(F.col("root").alias("node")).agg(F.count("*").alias("_size"))
    for c in ("src", "dst"):
        links = links.join(roots.select(F.col("node").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    own = entries.select("node").distinct().join(roots, "node", "left").select(F.col("node").alias("entry"), F.coalesce("root", "node").alias("_of"))
    own = checkpointed(own)
    closure = reach(links.where("src != dst"), own.select(F.col("_of").alias("node")), each=True)
    sums = closure.join(size, "node", "left").groupBy(F.col("entry").alias("_from")).agg(F.sum(F.coalesce("_size", F.lit(1))).alias("reached"))
    return own.join(sums, F.col("_of").eqNullSafe(F.col("_from"))).select("entry", "reached")


def repeated_calls(calls: DataFrame, edges: DataFrame, entries: DataFrame, cached: DataFrame) -> DataFrame:
    """LLM-02: model calls in functions that run again and again, because an entry point reaches them past no cache.

    calls: id, node, fixed (the request does not vary); entries: node, kind; cached: node. A function with a cache in front
    guards itself and what only it calls."""
    open_entries = entries.join(cached.select("node"), "node", "left_anti")
    near = reach(edges, open_entries.select("node"), stops=cached.select("node"))
    near = near.join(cached.select("node").distinct().withColumn("_cached", F.lit(True)), "node", "left").where("_cached IS NULL").drop("_cached")
    kinds = entries.groupBy(F.col("node").alias("entry")).agg(F.min("kind").alias("kind"))
    found = calls.join(near, "node", "left").join(kinds, "entry", "left")
    hit = F.col("hops").isNotNull() & F.col("fixed")
    return found.select("id", "node", "entry", "kind", "hops", F.when(hit, "detected").otherwise("clean").alias("status"))


def browser_fetches(requests: DataFrame, waits: DataFrame, capture: str, min_duplicates: int, min_gap: float) -> DataFrame:
    """NET-11: one row for each capture, refused where dependencies are missing or cyclic.

    requests: the capture, id, key (what makes requests the same), begin, end, exempt (retry, poll, preflight or redirect) and
    reviewed; waits: the capture, id, after_id. Requests that are not exempt and wait for nothing are independent. Families
    of equal ones are duplicates where no member waits; else, where all independent ones run one after the other
    with ``min_gap`` between them and were reviewed, they are a waterfall. critical is the longest chain of waiting requests."""
    named = requests.withColumn("_took", (F.col("end") - F.col("begin")).cast("double"))
    there = requests.select(capture, F.col("id").alias("after_id"), F.lit(True).alias("_there")).distinct()
    missing = waits.join(there, [capture, "after_id"], "left").where("_there IS NULL").groupBy(capture).agg(F.count("*").alias("missing"))
    peeled = peel(named, waits, [capture, "id"], "_took")
    waiting = waits.select(capture, "id").distinct().withColumn("_waits", F.lit(True))
    rows = peeled.join(waiting, [capture, "id"], "left").withColumn("_free", F.col("_waits").isNull())
    rows = checkpointed(rows)
    eligible = rows.where(~F.col("exempt"))
    families = eligible.groupBy(capture, "key").agg(F.count("*").alias("_n"), F.min("_free").alias("_all")).groupBy(capture).agg(F.count_if((F.col("_n") >= min_duplicates) & F.col("_all")).alias("duplicates"))
    w = Window.partitionBy(capture).orderBy("begin", "id")
    gaps = eligible.where("_free").select(capture, (F.col("begin") < F.lag("end").over(w) + min_gap).alias("_near"))
    serial = gaps.groupBy(capture).agg(F.count("*").alias("independent"), F.count_if("_near").alias("_overlaps"))
    every = rows.groupBy(capture).agg(F.count("*").alias("requests"), F.count_if("blocked").alias("blocked"), F.max("finish").alias("critical"), F.min("reviewed").alias("reviewed"))
    out = reduce(lambda a, b: a.join(b, capture, "left"), [every, missing, families, serial])
    refused = F.when(F.col("missing") > 0, "missing dependency").when(F.col("blocked") > 0, "cyclic dependency")
    number: list[Column] = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("duplicates", "independent")]
    out = out.select(capture, "requests", refused.alias("refused"), *number, "critical", "_overlaps", "reviewed")
    finding = F.when(F.col("refused").isNotNull(), None).when(F.col("duplicates") > 0, "duplicate").when((F.col("independent") >= 2) & (F.col("_overlaps") == 0) & F.col("reviewed"), "independent waterfall")
    return out.withColumns({"critical": F.when(F.col("refused").isNull(), F.col("critical")), "finding": finding}).withColumn("status", F.when(F.col("refused").isNotNull(), "omitted").when(F.col("finding").isNotNull(), "detected").otherwise("clean")).drop("_overlaps", "reviewed")
