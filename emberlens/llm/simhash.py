"""SimHash near-dedup: fingerprints of 64 bits link at a small Hamming distance, found by a distributed vantage-point tree.

A document's shingles are hashed with XXH64; a bit of its fingerprint is set where more than half of the hashes set it.
Equal fingerprints are one class from the start, so copies cost one row. The classes are joined exactly:

1. A region is a node of one vantage-point tree, named by its place as in a heap (the root is 1). A region that holds more
   than ``leaf`` classes gets a subtree of up to ``DEPTH`` levels, fitted on a bounded sample of its rows: each cut is a ball
   around a vantage point, the one of some candidates whose ball halves the sample with the fewest rows at its boundary.
   The sample only steers where balls stand; every class is routed.
2. A class within a ball's radius goes inside, any other outside. By the triangle inequality a class further than the radius
   plus the link distance has no partner inside, so that branch is pruned; one in between visits the inside as a guest, its
   mark holding the level of the cut. Two guests of one cut meet outside of it, so each pair is compared in exactly one leaf.
3. Rounds repeat until all regions are leaves, about one for each ``2 ** DEPTH`` times more classes. A region that no ball
   divides is compared in tiles of two blocks, so no task holds more than a leaf, whatever the distribution.
4. A leaf returns a row for each linked member: the number of documents that it links with there, and one member of its
   part. Components follow by min-label hooking. At most 2080 other fingerprints stand within two bits of one, so links
   of a class are bounded however large a family is.

Defined results: null, empty and blank texts have fingerprint zero and link as any other; a text of fewer words than a
shingle is one shingle, whose hash is the fingerprint; a bit that exactly half of the hashes set stays 0; a very long
text is hashed in slices, whole; rows that repeat a doc_id are judged each by its own text; a row without doc_id is linked
as others are, and its component is the smallest doc_id in it, null where there is none; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, materialize, slices, text_buffers, tune, word_spans
from .jaccard import components

#: Seed of the hash of a shingle.
SEED = 42
#: Hashes turned to bits at once.
AT_ONCE = 1 << 16
#: Classes of a leaf, levels of a subtree, rows that a subtree is fitted on, candidates for a vantage point.
LEAF, DEPTH, SAMPLE, CANDIDATES = 8192, 8, 1 << 14, 24
#: Levels that fit into a guest's mark; the two bits above are the sides of a tile.
LEVELS = 60
SIDES = (1 << 60, 1 << 61)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words with one space after each, where each word begins and ends there, and its row."""
    starts, ends, row = word_spans(data, offsets)
    size = ends - starts
    begin = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    # words stand in order and everything between them is white space, so the kept bytes fill the words' places in order
    inside = np.ones(len(out), bool)
    inside[begin + size] = False
    out[inside] = _LOWER[data[~SPACE[data]]]
    return out, begin, begin + size, row


def fingerprints(column: pa.Array, n: int) -> np.ndarray:
    """A fingerprint of each row's words, as unsigned 64-bit integers."""
    import xxhash

    data, offsets = text_buffers(column)
    prints = np.zeros(len(column), np.uint64)
    for a, b in slices(offsets):
        words, begin, end, row = joined_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        head, count = np.searchsorted(row, np.arange(b - a)), np.bincount(row, minlength=b - a)
        times = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        first = np.repeat(head - (np.cumsum(times) - times), times) + np.arange(times.sum())
        owner = np.repeat(np.arange(b - a), times)
        last = first + np.minimum(count[owner], n) - 1
        view, digest = memoryview(words.tobytes()), xxhash.xxh64_intdigest
        set_in = np.zeros((b - a, 64), np.int64)
        for at in range(0, len(first), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            spans = zip(begin[first[part]].tolist(), end[last[part]].tolist(), strict=True)
            hashes = np.array([digest(view[s:e], SEED) for s, e in spans], "<u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            who, heads = np.unique(owner[part], return_index=True)
            set_in[who] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        prints[a:b] = np.packbits(2 * set_in > times[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return prints


def signed(prints: np.ndarray) -> pa.Array:
    return pa.array(prints.astype(np.uint64).view(np.int64))


def fingerprinted(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id and x, the fingerprint as a signed long, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), signed(fingerprints(batch.column(1), n))], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, x long")


def best_ball(sample: np.ndarray, bits: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that divide the sample with few rows at the boundary; None where no ball gains.

    The complement of a candidate is one too: the inside of its ball is the outside of the candidate's."""
    drawn = rng.choice(sample, min(CANDIDATES, len(sample)), replace=False)
    best, found = 0.97, None
    for point in np.concatenate([drawn, ~drawn]):
        at = np.bincount(np.bitwise_count(sample ^ point), minlength=65 + bits) / len(sample)
        inside = np.cumsum(at)
        guests = np.array([at[r + 1 : r + 1 + bits].sum() for r in range(64)])
        # what is left to compare, if each side went on being cut at the same rate
        cost = (inside[:64] + guests) ** 1.4 + np.maximum(1 - inside[:64], 0) ** 1.4
        r = int(cost.argmin())
        if cost[r] < best:
            best, found = float(cost[r]), (point, r)
    return found


def fit(sample: np.ndarray, root: int, held: int, leaf: int, bits: int) -> dict[int, tuple[int, int]]:
    """The cuts of a region's subtree, by node: vantage point and radius. held: how many rows the sample stands for."""
    cuts, rng = {}, np.random.default_rng(root % (1 << 32))
    todo = [(root, sample)]
    scale = held / max(len(sample), 1)
    while todo:
        node, own = todo.pop()
        level = node.bit_length() - 1
        if len(own) * scale <= leaf / 2 or len(own) < 2 or level >= LEVELS or level - root.bit_length() + 1 >= DEPTH:
            continue
        ball = best_ball(own, bits, rng)
        if ball is None:
            continue
        far = np.bitwise_count(own ^ ball[0])
        cuts[node] = (int(ball[0]), ball[1])
        todo += [(2 * node, own[far <= ball[1] + bits]), (2 * node + 1, own[far > ball[1]])]
    return cuts


def route(x: np.ndarray, guest: np.ndarray, root: int, cuts: dict[int, tuple[int, int]], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The leaves of a subtree that rows reach: node, places in ``x``, and their marks."""
    todo = [(root, np.arange(len(x)), guest)]
    while todo:
        node, at, mark = todo.pop()
        if node not in cuts:
            yield node, at, mark
            continue
        point, radius = cuts[node]
        far = np.bitwise_count(x[at] ^ np.uint64(point))
        visits = (far > radius) & (far <= radius + bits)
        near, level = (far <= radius) | visits, np.int64(1 << (node.bit_length() - 1))
        todo += [(2 * node, at[near], np.where(visits, mark | level, mark)[near]), (2 * node + 1, at[far > radius], mark[far > radius])]


def links_within(x: np.ndarray, guest: np.ndarray, copies: np.ndarray, bits: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Of a leaf's members: the documents of others that each links with here, and its part's first member."""
    links, part = np.zeros(len(x), np.int64), np.arange(len(x))
    for a in range(0, len(x), rows):
        b = min(a + rows, len(x))
        near = (np.bitwise_count(x[a:b, None] ^ x[None]) <= bits) & ((guest[a:b, None] & guest[None]) == 0)
        i, j = np.nonzero(near)
        i += a
        i, j = i[i != j], j[i != j]
        links += np.bincount(i, copies[j], len(x)).astype(np.int64)
        while True:
            while (part[part] != part).any():
                part = part[part]
            p, q = part[i], part[j]
            if (p == q).all():
                break
            np.minimum.at(part, np.maximum(p, q), np.minimum(p, q))
    return links, part


def _fitted(leaf: int, bits: int):
    def run(key, pdf):
        import pandas as pd

        cuts = fit(pdf.x.to_numpy().view(np.uint64), int(key[0]), int(pdf.held.iloc[0]), leaf, bits)
        nodes = sorted(cuts)
        points = np.array([cuts[k][0] for k in nodes], np.uint64).view(np.int64).tolist()
        return pd.DataFrame({"r": [key[0]], "blocks": [pdf.blocks.iloc[0]], "nodes": [nodes], "points": [points], "radii": [[cuts[k][1] for k in nodes]]})

    return run


def _routed(bits: int):
    def run(key, pdf, tree):
        import pandas as pd

        x, out = pdf.x.to_numpy(), []
        cuts = {}
        if len(tree):
            points = np.array(tree.points.iloc[0], np.int64).view(np.uint64).tolist()
            cuts = dict(zip(map(int, tree.nodes.iloc[0]), zip(points, map(int, tree.radii.iloc[0]), strict=True), strict=True))
        for node, at, mark in route(x.view(np.uint64), pdf.guest.to_numpy(), int(key[0]), cuts, bits) if len(x) else ():
            out.append(pd.DataFrame({"x": x[at], "copies": pdf.copies.to_numpy()[at], "r": node, "guest": mark, "above": key[0]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("x", "copies", "r", "guest", "above")})

    return run


def leaves(classes: DataFrame, bits: int, leaf: int) -> DataFrame:
    """x, copies, guest and the leaf (r, one, two) of ``classes`` (x, copies), guests included; one and two are a tile's blocks."""
    held = classes.count()
    work = classes.select("x", "copies", F.lit(1).cast("long").alias("r"), F.lit(0).cast("long").alias("guest"), F.lit(held).cast("long").alias("held"))
    done = None
    while True:
        small = work.where(F.col("held") <= leaf).select("x", "copies", "r", "guest", F.lit(0).alias("one"), F.lit(0).alias("two"))
        done = small if done is None else done.unionByName(small)
        large = work.where(F.col("held") > leaf)
        if large.isEmpty():
            return done
        large = large.withColumn("blocks", F.ceil(2 * F.col("held") / leaf).cast("int"))
        every = F.greatest(F.lit(1), F.floor(F.col("held") / SAMPLE))
        drawn = large.where(F.pmod(F.xxhash64("x", "r"), every) == 0)
        trees = drawn.groupBy("r").applyInPandas(_fitted(leaf, bits), "r long, blocks int, nodes array<long>, points array<long>, radii array<int>")
        trees = trees.select("r", "nodes", "points", "radii", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        own = large.withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
        placed = own.groupBy("r", "block").cogroup(trees.groupBy("r", "block")).applyInPandas(_routed(bits), "x long, copies long, r long, guest long, above long")
        placed = materialize(placed, "simhash-placed")
        sizes = placed.where("r != above").groupBy("r").agg(F.count("*").alias("held"))
        work = materialize(placed.where("r != above").join(sizes, "r").select("x", "copies", "r", "guest", "held"), "simhash-regions")
        # regions that no ball divides: every two blocks meet in a tile
        whole = placed.where("r = above")
        whole = whole.join(whole.groupBy("r").agg(F.ceil(2 * F.count("*") / leaf).cast("int").alias("blocks")), "r")
        mine, other = F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"), F.col("other")
        whole = whole.select("*", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        side = F.when(F.col("mine") == other, 0).when(F.col("mine") < other, SIDES[0]).otherwise(SIDES[1])
        done = done.unionByName(whole.select("x", "copies", "r", F.col("guest").bitwiseOR(side).alias("guest"), F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two")))


def _leaf(bits: int):
    def run(pdf):
        import pandas as pd

        x = pdf.x.to_numpy()
        links, part = links_within(x.view(np.uint64), pdf.guest.to_numpy(), pdf.copies.to_numpy(), bits)
        some = links > 0
        return pd.DataFrame({"x": x[some], "y": x[part][some], "links": links[some]})

    return run


def join(docs: DataFrame, n: int = 3, bits: int = 2, leaf: int = LEAF) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id, and n_links, the number of other documents that link with it."""
    tune(docs.sparkSession)
    named = materialize(fingerprinted(docs, n), "simhash-prints")
    classes = materialize(named.groupBy("x").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "simhash-classes")
    found = leaves(classes.select("x", "copies"), bits, leaf).groupBy("r", "one", "two").applyInPandas(_leaf(bits), "x long, y long, links long")
    found = materialize(found, "simhash-links")
    roots = components(found.where("x != y").select("x", "y"))
    links = found.groupBy("x").agg(F.sum("links").alias("links"))
    full = classes.join(roots.select(F.col("node").alias("x"), "root"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    ids = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = full.join(ids, "root").join(links, "x", "left").select("x", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    of_class = materialize(of_class, "simhash-components")
    discard(found)
    discard(classes)
    return named.join(of_class, "x").select("doc_id", F.lower(F.lpad(F.hex("x"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
