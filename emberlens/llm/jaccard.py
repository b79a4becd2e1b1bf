"""Exact n-gram Jaccard join: documents link when their sets of 5-word shingles reach the similarity.

Jaccard distance is a metric, with radius r = 1 - similarity. Texts that have nothing in common all stand at distance 1
of each other, where a window of 2r holds everything and document pivots alone separate nothing (with random documents as
pivots, all regions would get all documents). So regions are cut in steps, each of them exact.

1. Shingles are the first pivots. Shingles are ordered, common ones last, by hash otherwise; a document's boundary is its
   first n - ceil(similarity * n) + 1 shingles, and linked documents share one of these. Regions of at most ``common``
   sets are compared right away: their pairs are counted over all regions, and a pair whose shared boundary can't be
   completed to the needed overlap is dropped before any set is read.
2. Larger regions hold documents that consist of common shingles for the most part: families of near copies. Regions that
   share members are one family, so every member's set travels once. A family up to the size of a leaf is joined there,
   by products of its incidence matrix.
3. A larger family is cut by document pivots into Voronoi regions: a member's home is its nearest pivot, and it visits
   region j as a guest where d(x, p_j) <= d(x, home) + 2r, the window that the triangle inequality leaves; of two homes the
   earlier one is visited, so each pair meets once. Regions are cut again until they are leaves.
4. Where pivots separate nothing (the members of a family often stand within 2r of each other), a region is joined in
   tiles: blocks of a leaf's size meet pairwise. So no task holds more than two blocks, and no pair is ever a row.

Leaves return one row for a member and leaf: its number of links there and one linked member that its part of the leaf
shares; components follow by min-label hooking with pointer jumps. Equal sets are one class from the start; classes are
compared instead of documents, and ``n_links`` counts documents. Sets are hashed to 64 bits a shingle. Common shingles
are at most 2**20, most frequent first; the choice affects the order of shingles and not the result.

Defined results: null, empty and blank texts have the empty set and link with nothing; with fewer than n words the whole
sequence is the only shingle; rows that repeat a doc_id are judged each by its own text; a row without doc_id is linked as
others are, and its component is the smallest doc_id in it, null where there is none; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, marked, materialize, mix, packed, runs_of, slices, span_hashes, text_buffers, tune, unpacked, word_spans

MOST_COMMON = 1 << 20
FLUSH = 1 << 20
#: Shingles that are counted before they are sent.
COUNTED = 1 << 22
#: A leaf's bounds: members, and shingles of all of them.
LEAF_ROWS, LEAF_SHINGLES = 1024, 1 << 20
#: Pivots of a region, about.
PIVOTS = 24
#: Guest marks of the two sides of a tile.
SIDES = (1 << 60, 1 << 61)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows: first row, end row, the sets one after the other, each ascending, and where each begins."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, row = word_spans(part, off)
        h = span_hashes(part, starts, ends, fold=True)
        grams, first = runs_of(h, row, n)
        owner = row[first]
        words = np.bincount(row, minlength=b - a)
        for k in range(1, n):  # whole short texts
            short, at = runs_of(h, row, k)
            pick = words[row[at]] == k
            grams, owner = np.concatenate([grams, mix(short[pick] + np.uint64(k))]), np.concatenate([owner, row[at[pick]]])
        order = np.lexsort([grams, owner])
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
        yield a, b, grams, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b - a))])


def _class_of(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64)])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


def boundary(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of n among which every linked set shares one."""
    return n - -(-n * percent // 100) + 1


def overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles that sets of n and m need to link."""
    return -(-(n + m) * percent // (100 + percent))


def classes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and class of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, grams, at in shingle_sets(batch.column(1), n):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(_class_of(grams, at).view(np.int64))], names=["doc_id", "n_shingles", "class"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_shingles long, class long")


def _fresh(name: np.ndarray, size: np.ndarray, seen: set) -> np.ndarray:
    """Which sets are neither empty nor in ``seen``, to which they are added."""
    return np.array([s > 0 and c not in seen and not seen.add(c) for s, c in zip(size.tolist(), name.tolist(), strict=True)], bool)


def _boundaries(column: pa.Array, n: int, percent: int, common: np.ndarray, seen: set) -> Iterator[tuple[np.ndarray, ...]]:
    """Boundary shingles of sets not in ``seen``, whether each is common and which set's it is; class, size, last boundary place and common count of the sets."""
    for _, _, grams, at in shingle_sets(column, n):
        name, size = _class_of(grams, at), np.diff(at)
        fresh = _fresh(name, size, seen)
        owner = np.repeat(np.arange(len(size)), size)
        if len(common):
            late = _is_common(grams, common)
            order = np.lexsort([grams, late, owner])
            grams, late = grams[order], late[order]
        else:
            late = np.zeros(len(grams), bool)
        place = np.arange(len(grams)) - at[:-1][owner]
        reach = boundary(size, percent)
        inside = (place < reach[owner]) & fresh[owner]
        key, who, late = grams[inside], owner[inside], late[inside]
        n_late = np.bincount(who, late, minlength=len(size)).astype(np.uint32)
        ends = np.zeros(len(size), np.uint64)
        last = np.flatnonzero(np.concatenate([who[1:] != who[:-1], [True]])) if len(who) else []
        ends[who[last]] = (key[last] >> np.uint64(33)) | (late[last].astype(np.uint64) << np.uint64(31))  # its place in the order, 32 bits
        held = np.flatnonzero(fresh)
        yield key, late, np.searchsorted(held, who), name[held], size[held].astype(np.uint32), ends[held].astype(np.uint32), n_late[held]


def _dealt(dealt: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Each bucket that has some of ``dealt``, which ascends, and where."""
    bucket = (dealt >> np.uint64(32)).astype(np.int64) * buckets >> 32
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    return ((k, slice(cuts[k], cuts[k + 1])) for k in range(buckets) if cuts[k] < cuts[k + 1])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each bucket of this task, without it; a task has one bucket, or few small ones."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(row[0], []).append(row[1:])
    for bucket in sorted(held):
        yield held.pop(bucket)


def _gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def short(grams: np.ndarray, wide: bool) -> np.ndarray:
    """What stands for a shingle in the table of common ones: 32 bits tell them apart well enough for an order."""
    return grams if wide else (grams >> np.uint64(32)).astype(np.uint32)


def common_shingles(docs: DataFrame, n: int, common: int, buckets: int, wide: bool) -> np.ndarray:
    """The shingles of more than ``common`` different sets, the most frequent of them, ascending.

    Equal shingles are counted before they are sent, so a shingle of every document is one entry of a flush; shingles ascend, so
    their gaps are what is sent."""
    kind = "u8" if wide else "u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, seen = [], 0, set()

        def out() -> pa.RecordBatch:
            key, times = np.unique(np.concatenate(parts), return_counts=True)
            times = times.astype(np.uint32)
            rows = [(k, packed(_gaps(key[at])), packed(times[at])) for k, at in _dealt(key if wide else key.astype(np.uint64) << np.uint64(32), buckets)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["bucket", "c0", "c1"])

        for batch in batches:
            for _, _, grams, at in shingle_sets(batch.column(0), n):
                fresh = _fresh(_class_of(grams, at), np.diff(at), seen)
                own = short(grams[np.repeat(fresh, np.diff(at))], wide)
                parts.append(own)
                size += len(own)
                if size > COUNTED:
                    yield out()
                    parts, size = [], 0
        if size:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches):
            key = np.concatenate([np.cumsum(unpacked(gaps, kind), dtype=kind) for gaps, _ in rows])
            times = np.concatenate([unpacked(own, "u4") for _, own in rows])
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            total = np.add.reduceat(times.astype(np.int64), head)
            often = total > common
            yield pa.RecordBatch.from_arrays([pa.array(key[head[often]].astype(np.uint64).view(np.int64)), pa.array(total[often])], names=["key", "n"])

    sent = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, c0 binary, c1 binary")
    counts = sent.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(count, "key long, n long")
    top = counts.orderBy(F.desc("n"), "key").limit(MOST_COMMON).select("key").toArrow().column(0).to_numpy().view(np.uint64)
    return np.sort(top).astype(kind)


def _is_common(keys: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common) or not len(keys):
        return np.zeros(len(keys), bool)
    own = short(keys, common.dtype.itemsize == 8)
    return common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own


def _level(size: np.ndarray) -> np.ndarray:
    """A byte for a set's size, by steps of 9 %."""
    return np.floor(np.log(size) / np.log(1.09)).astype(np.uint8)


def regions(docs: DataFrame, n: int, percent: int, most: int, common: np.ndarray, buckets: int) -> DataFrame:
    """Rows of three kinds: pairs x < y of small regions with the boundary shingles they share (more at times, never fewer), members
    x of region ``r``, and the class, size m and last boundary place of set x, m plus 2**31 if its boundary has common shingles.

    A set has a number here, that of its batch plus its place there, so an entry is sent as the gap to the last shingle, a place and a
    byte for the size: about 6 bytes however many buckets there are. What else is known of a set is sent once. Entries of common
    shingles are dealt by set, as they only become members, so no bucket is hot. Shingles are cut to 48 bits, which can only
    join regions."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(common)
    cut = np.uint64(0 if common.dtype.itemsize == 8 else 16)
    steps = int(np.log(100 / percent) / np.log(1.09) + 1 + 1e-9)

    def out(parts: list[tuple], held: list[tuple]) -> pa.RecordBatch:
        key, late, who, level = (np.concatenate(c) for c in zip(*parts, strict=True))
        name, m, last = (np.concatenate(c) for c in zip(*held, strict=True))
        origin = mix(np.bitwise_xor.reduce(mix(name ^ mix(np.arange(len(name), dtype=np.uint64))), keepdims=True))
        rows = []
        for of_set in (False, True):
            pick = np.flatnonzero(late == of_set)
            deal = mix(origin + who[pick].astype(np.uint64)) if of_set else key[pick]
            order = np.argsort(deal, kind="stable")
            pick, deal = pick[order], deal[order]
            for k, at in _dealt(deal, buckets):
                own = pick[at]
                if of_set:
                    own = own[np.argsort(key[own], kind="stable")]
                rows.append((k, int(origin.view(np.int64)[0]), packed(_gaps(key[own] >> cut)), packed(who[own].astype(np.uint32)), packed(level[own]), None, None, None))
        k = next(_dealt(origin, buckets))[0]
        rows.append((k, int(origin.view(np.int64)[0]), None, None, None, name.tobytes(), m.tobytes(), last.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 2 + [pa.binary()] * 6, strict=True)], names=["bucket", "origin", *(f"c{i}" for i in range(6))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, size, at, seen = [], [], 0, 0, set()
        for batch in batches:
            for key, late, who, name, m, last, n_late in _boundaries(batch.column(0), n, percent, sent.value, seen):
                parts.append((key, late, at + who, _level(m)[who]))
                held.append((name, m | (n_late > 0).astype(np.uint32) << np.uint32(31), last))
                size, at = size + len(key), at + len(name)
                if size > FLUSH:
                    yield out(parts, held)
                    parts, held, size, at = [], [], 0, 0
        if size:
            yield out(parts, held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches):
            entries = []
            for origin, gaps, who, level, name, m, last in rows:
                first = np.array([origin], np.int64).view(np.uint64)
                if gaps is None:
                    name = np.frombuffer(name, np.uint64)
                    yield _rows(x=first + np.arange(len(name), dtype=np.uint64), name=name, m=np.frombuffer(m, np.uint32), last=np.frombuffer(last, np.uint32))
                else:
                    entries.append((np.cumsum(unpacked(gaps, "u8"), dtype=np.uint64) << cut, first + unpacked(who, "u4").astype(np.uint64), unpacked(level, "u1")))
            if not entries:
                continue
            key, name, level = (np.concatenate(c) for c in zip(*entries, strict=True))
            order = np.lexsort([name, key])
            key, name, level = key[order], name[order], level[order].astype(np.int16)
            late = _is_common(key, sent.value)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            large = late | np.repeat(sizes > most, sizes)
            if large.any():
                yield _rows(x=name[large], region=key[large])
            small = (sizes > 1) & ~large[starts]
            starts, sizes = starts[small], sizes[small]
            pairs: list[np.ndarray] = []
            for width in np.unique(sizes):
                first = starts[sizes == width]
                i, k = np.triu_indices(int(width), 1)
                for chunk in np.array_split(first, max(1, len(first) * len(i) // 2_000_000)):
                    x, y = (chunk[:, None] + i).ravel(), (chunk[:, None] + k).ravel()
                    near = (np.abs(level[x] - level[y]) <= steps) & (name[x] != name[y])
                    pairs.append(np.stack([x[near], y[near]]))
            if pairs:
                x, y = np.concatenate(pairs, axis=1)
                order = np.lexsort([name[y], name[x]])
                x, y = x[order], y[order]
                head = np.flatnonzero(np.concatenate([[True], (name[x[1:]] != name[x[:-1]]) | (name[y[1:]] != name[y[:-1]])])) if len(x) else np.empty(0, int)
                yield _rows(x=name[x[head]], y=name[y[head]], shared=np.diff(np.concatenate([head, [len(x)]])))

    def _rows(x, y=None, shared=None, region=None, name=None, m=None, last=None) -> pa.RecordBatch:
        none = pa.nulls(len(x), pa.int64())
        long = lambda c: none if c is None else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64))
        return pa.RecordBatch.from_arrays([long(c) for c in (x, y, shared, region, name, m, last)], names=["x", "y", "shared", "r", "class", "m", "last"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, origin long, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, c5 binary")
    return parts.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(join, "x long, y long, shared long, r long, class long, m long, last long")


def candidates(found: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the rows of ``regions``: pairs of classes x < y that may link, and classes x of regions ``r``."""
    known = found.where("class IS NOT NULL").select("x", "class", "m", "last").dropDuplicates(["x"])
    side = lambda c: known.select(F.col("x").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("class", "m", "last")))
    pairs = found.where("y IS NOT NULL").groupBy("x", "y").agg(F.sum("shared").alias("shared")).join(side("x"), "x").join(side("y"), "y").where("class_x != class_y")
    a, b = (F.col(f"m_{c}").bitwiseAND(0x7FFFFFFF) for c in "xy")
    up = lambda c, d: F.floor((c + (d - 1)) / d).cast("long")
    # the side whose boundary ends first has shown all it shares there; common shingles may be shared as well
    early = [up((a + b) * percent, 100 + percent) - up(z * percent, 100) + 1 for z in (a, b)]
    least = F.when(F.col("last_x") < F.col("last_y"), early[0]).when(F.col("last_x") > F.col("last_y"), early[1]).otherwise(F.least(*early))
    least = F.when(F.col("m_x").bitwiseOR(F.col("m_y")) >= 1 << 31, 0).otherwise(least)
    pairs = pairs.where((F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (F.col("shared") >= least))
    pairs = pairs.select(F.least("class_x", "class_y").alias("x"), F.greatest("class_x", "class_y").alias("y")).distinct()
    members = found.where("r IS NOT NULL").select("x", "r").join(known.select("x", "class"), "x").select("r", F.col("class").alias("x")).distinct()
    return pairs, members


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class, s, its shingles, and what else ``wanted`` (class, doc_id) has, for the classes there.

    Rows are chosen by marks of their ids, so a doc_id that many rows share, or that many rows lack, gives each of them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, grams, at in shingle_sets(batch.column(0), n):
                keep = pa.array(np.flatnonzero(np.diff(at)))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_class_of(grams, at).view(np.int64)).take(keep), lists.take(keep)], names=["class", "s"])

    # texts are not shuffled: the few unwanted sets go with the classes
    chosen = marked(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id", wanted.select("doc_id"), "_chosen").where("_chosen").select("text")
    sets = chosen.mapInArrow(run, "class long, s array<long>")
    return sets.join(wanted.drop("doc_id").dropDuplicates(["class"]), "class").dropDuplicates(["class"])


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """shared and either of pairs (x, y): the sizes of intersection and union."""
    left, right = (sets.select(F.col("class").alias(c), F.col("s").alias(f"s_{c}")) for c in "xy")
    both = pairs.join(left, "x").join(right, "y")
    shared = F.size(F.array_intersect("s_x", "s_y")).cast("long")
    return both.select(*pairs.columns, shared.alias("inter"), (F.size("s_x") + F.size("s_y") - shared).alias("either"))


def families(members: DataFrame) -> DataFrame:
    """x and r, its family, for the members of regions (x, r) that have company: regions that share members are one family."""
    held = members.groupBy("r").agg(F.min("x").alias("y"), F.count("*").alias("n")).where("n > 1").select("r", "y")
    links = materialize(members.join(held, "r").where("x != y").select("x", "y").distinct(), "jaccard-near")
    roots = components(links)
    return materialize(roots.select(F.col("node").alias("x"), F.col("root").alias("r")), "jaccard-families")


def _postings(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in order, and whose they are."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    every = np.concatenate(lists) if lists else np.empty(0, np.int64)
    order = np.argsort(every, kind="stable")
    return every[order], owner[order]


def links_within(lists: list[np.ndarray], guest: np.ndarray, copies: np.ndarray, percent: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Of sets: the number of documents that each links with, and its part's first set.

    Sets that are guests of the same cut (their marks share a bit) meet elsewhere. Shingles of many sets are multiplied as
    a dense matrix, the others through their postings."""
    k, n = len(lists), np.array([len(x) for x in lists], np.int64)
    every, owner = _postings(lists)
    head = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, int)
    df = np.diff(np.concatenate([head, [len(every)]]))
    column = np.repeat(np.arange(len(head)), df)
    dense = df > max(16, k // 8)
    matrix = np.zeros((k, int(dense.sum())), np.float32)
    place = np.cumsum(dense) - 1
    inside = dense[column]
    matrix[owner[inside], place[column[inside]]] = 1
    rare = np.flatnonzero(~inside & (df[column] > 1))
    rare = rare[np.argsort(owner[rare], kind="stable")]
    cuts = np.searchsorted(owner[rare], np.arange(k + 1))
    links, part = np.zeros(k, np.int64), np.arange(k)
    for a in range(0, k, rows):
        b = min(a + rows, k)
        inter = (matrix[a:b] @ matrix.T).astype(np.int64)
        own = rare[cuts[a] : cuts[b]]
        size = df[column[own]]
        until = np.cumsum(size)
        at = 0
        while at < len(own):
            stop = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + 2_000_000, "right")))
            some, times = own[at:stop], size[at:stop]
            begin = head[column[some]] - (np.cumsum(times) - times)
            who = owner[np.repeat(begin, times) + np.arange(times.sum())]
            inter += np.bincount(np.repeat(owner[some] - a, times) * k + who, minlength=(b - a) * k).reshape(b - a, k)
            at = stop
        near = (inter * 100 >= (n[a:b, None] + n[None] - inter) * percent) & ((guest[a:b, None] & guest[None]) == 0)
        near[np.arange(b - a), np.arange(a, b)] = False
        links[a:b] = near @ copies
        for i in range(a, b):
            others = part[near[i - a]]
            if (others != part[i]).any():
                found = np.unique(np.append(others, part[i]))
                part[np.isin(part, found)] = found[0]
    return links, part


def _leaf(pdf, percent: int):
    """x, y, links: the members of a leaf, another of the same part and the documents they link with here."""
    import pandas as pd

    x = pdf.x.to_numpy()
    links, part = links_within(list(pdf.s), pdf.guest.to_numpy(), pdf.copies.to_numpy(), percent)
    return pd.DataFrame({"x": x, "y": x[part], "links": links})


def _homes(members, pivots, level: int, radius: float):
    """x, r, guest: the Voronoi regions of a block of members, those it visits included."""
    import pandas as pd

    if not len(members) or not len(pivots):  # without a pivot the region stays whole, and is joined in tiles
        return members[["x", "r", "guest"]].astype(np.int64) if len(members) else pd.DataFrame({c: np.empty(0, np.int64) for c in ("x", "r", "guest")})
    # of pivots within the window of each other one stays, as they would share all they have; every block keeps the same
    pivots, apart = pivots.sort_values("pivot_x"), []
    for k, s in enumerate(pivots.pivot_s):
        if all(1 - (both := len(np.intersect1d(s, t, assume_unique=True))) / (len(s) + len(t) - both) > 2 * radius for t in (pivots.pivot_s.iloc[j] for j in apart)):
            apart.append(k)
    pivots = pivots.iloc[apart]
    every, owner = _postings(list(members.s))
    n = np.array([len(s) for s in members.s])
    far = np.empty((len(members), len(pivots)))
    for j, s in enumerate(pivots.pivot_s):
        lo, hi = np.searchsorted(every, s), np.searchsorted(every, s, "right")
        size = hi - lo
        inter = np.bincount(owner[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())], minlength=len(members))
        far[:, j] = 1 - inter / (n + len(s) - inter)
    home = far.argmin(1)
    least = far[np.arange(len(members)), home]
    row, visited = np.nonzero((far <= least[:, None] + 2 * radius + 1e-9) & (np.arange(len(pivots)) < home[:, None]))
    names = mix(pivots.pivot_x.to_numpy().view(np.uint64) ^ mix(np.full(len(pivots), members.r.iloc[0], np.int64).view(np.uint64) + np.uint64(level + 1))).view(np.int64)
    x, guest = members.x.to_numpy(), members.guest.to_numpy()
    return pd.DataFrame({"x": np.concatenate([x, x[row]]), "r": names[np.concatenate([home, visited])], "guest": np.concatenate([guest, guest[row] | (1 << level)])})


def _cut(level: int, radius: float):
    return lambda key, members, pivots: _homes(members, pivots, level, radius).assign(above=key[0])


def leaves(work: DataFrame, sets: DataFrame, percent: int, rows: int, shingles: int) -> DataFrame:
    """x, r, guest: the regions of ``work`` (x, r, guest, n) cut until each is a leaf or a tile of two blocks."""
    done = None
    for level in range(40):
        sized = materialize(work.groupBy("r").agg(F.count("*").alias("held"), F.sum("n").alias("total")), "jaccard-sizes")
        blocks = F.greatest(F.ceil(2 * F.col("held") / rows), F.ceil(2 * F.col("total") / shingles)).cast("int")
        large = sized.where((F.col("held") > rows) | (F.col("total") > shingles)).withColumn("blocks", blocks)
        part = work.join(large.select("r"), "r", "left_anti").select("x", "r", "guest")
        done = part if done is None else done.unionByName(part)
        if large.isEmpty():
            return done
        rest = materialize(work.join(large, "r"), "jaccard-large")
        drawn = F.pmod(F.xxhash64("x", F.lit(level)), F.greatest(F.lit(1), F.floor(F.col("held") / PIVOTS))) == 0
        pivots = rest.where(drawn | (F.col("x") == F.col("r"))).select("x", "r", "blocks").distinct()
        pivots = pivots.join(sets.select(F.col("class").alias("x"), "s"), "x").select(F.col("r").alias("pivot_r"), F.col("x").alias("pivot_x"), F.col("s").alias("pivot_s"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("pivot_block"))
        held = rest.join(sets.select(F.col("class").alias("x"), "s"), "x").select("x", "r", "guest", "s", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("block"))
        placed = held.groupBy("r", "block").cogroup(pivots.groupBy("pivot_r", "pivot_block")).applyInPandas(_cut(level, 1 - percent / 100), "x long, r long, guest long, above long")
        placed = materialize(placed, "jaccard-homes")
        # where guests outweigh members, or one region keeps most of them, pivots separate nothing
        cells = placed.groupBy("above", "r").agg(F.count("*").alias("n"))
        gain = cells.groupBy("above").agg(F.sum("n").alias("all"), F.max("n").alias("most")).join(sized.withColumnRenamed("r", "above"), "above")
        dense = materialize(gain.where((F.col("all") > 2 * F.col("held")) | (F.col("most") > 0.8 * F.col("held"))).select("above"), "jaccard-dense")
        tiled = rest.join(dense.withColumnRenamed("above", "r"), "r", "left_semi")
        own = F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")
        tiled = tiled.select("x", "r", "guest", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), SIDES[0]).otherwise(SIDES[1])
        tile = F.xxhash64("r", F.least("own", "other"), F.greatest("own", "other"))
        done = done.unionByName(tiled.select("x", tile.alias("r"), F.col("guest").bitwiseOR(side).alias("guest")))
        work = placed.join(dense, "above", "left_anti").join(work.select("x", "n").distinct(), "x").select("x", "r", "guest", "n")
    raise ValueError("regions have been cut 40 times")


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for the ends of ``links`` (x, y)."""
    edges = materialize(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "cc-edges")
    label = materialize(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")), "cc-labels")
    while True:
        # a component's labels learn the least label at any neighbour, and then follow it
        seen = edges.join(label.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        hooked = label.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = hooked.groupBy(F.col("old").alias("node")).agg(F.min("root").alias("to"))
        moved = hooked.join(jump.select(F.col("node").alias("root"), "to"), "root", "left").select("node", "old", F.least("root", F.coalesce("to", "root")).alias("root"))
        new = materialize(moved, "cc-labels")
        changed = not new.where("root != old").isEmpty()
        discard(label)
        label = new.select("node", "root")
        label._scratch = new._scratch
        if not changed:
            return label


def join(docs: DataFrame, n: int = 5, percent: int = 75, common: int = 8, leaf_rows: int = LEAF_ROWS, leaf_shingles: int = LEAF_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, class (equal for equal sets) and n_links, the number of other documents that link with it."""
    spark = docs.sparkSession
    tune(spark)
    named = materialize(classes(docs, n), "jaccard-classes")
    total = named.agg(F.sum("n_shingles").alias("k")).first().k or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * (100 - percent) // 100 // 1_000_000) + 1)
    reps = materialize(named.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("n_shingles").alias("n")), "jaccard-reps")
    # copies of a set are left out, but for those whose ids are marked by chance or shared with others
    firsts = marked(docs.select("doc_id", "text"), "doc_id", reps.select("doc_id"), "_first").where("_first")
    often = common_shingles(firsts, n, common, buckets, wide=total > 1 << 34)
    found = materialize(regions(firsts, n, percent, common, often, buckets), "jaccard-regions")
    pairs, members = candidates(found, percent)
    family = families(members)
    # members of one family meet there
    pairs = pairs.join(family.select("x", F.col("r").alias("r_x")), "x", "left").join(family.select(F.col("x").alias("y"), F.col("r").alias("r_y")), "y", "left")
    pairs = materialize(pairs.where("NOT coalesce(r_x = r_y, false)").select("x", "y"), "jaccard-pairs")
    discard(found)
    paired = pairs.select(F.col("x").alias("class")).union(pairs.select("y")).select("class", F.lit(True).alias("paired"), F.lit(False).alias("related"))
    wanted = paired.union(family.select("x", F.lit(False), F.lit(True))).groupBy("class").agg(F.max("paired").alias("paired"), F.max("related").alias("related"))
    every = materialize(_sets(docs, wanted.join(reps.select("class", "doc_id"), "class"), n), "jaccard-sets")
    sets = every.where("related").select("class", "s")
    size = reps.select(F.col("class").alias("x"), "copies", "n")
    linked = _distances(pairs, every.where("paired").select("class", "s")).where(F.col("inter") * 100 >= F.col("either") * percent).select("x", "y")
    linked = materialize(linked, "jaccard-links")
    both = linked.unionByName(linked.select(F.col("y").alias("x"), F.col("x").alias("y")))
    counted = both.join(size.select(F.col("x").alias("y"), F.col("copies").alias("links")), "y").select("x", "y", "links")
    if not family.isEmpty():
        work = family.join(size, "x").select("x", "r", F.lit(0).cast("long").alias("guest"), "n")
        leaf = leaves(work, sets, percent, leaf_rows, leaf_shingles)
        full = leaf.join(sets.select(F.col("class").alias("x"), "s"), "x").join(size.select("x", "copies"), "x")
        within = full.groupBy("r").applyInPandas(lambda pdf: _leaf(pdf, percent), "x long, y long, links long")
        counted = counted.unionByName(within)
    counted = materialize(counted, "jaccard-counted")
    discard(every)
    roots = components(counted.where("x != y").select("x", "y"))
    links = counted.groupBy(F.col("x").alias("class")).agg(F.sum("links").alias("links"))
    full = reps.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("class", "doc_id", "copies", F.coalesce("root", "class").alias("root"))
    ids = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = full.join(ids, "root").join(links, "class", "left").select("class", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = named.join(of_class, "class", "left")
    some = F.col("n_shingles") > 0
    return out.select("doc_id", "n_shingles", F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class", F.when(some, F.col("links")).otherwise(0).cast("long").alias("n_links"))
