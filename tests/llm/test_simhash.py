"""SimHash near-dedup against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from odd_rows import ODD, prose, rich

from emberlens.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def print_of(text, n=3):
    w = WORD.findall((text or "").translate(LOWER))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def by_force(rows, bits=2):
    """doc_id, fingerprint, component and links of rows (doc_id, fingerprint)."""
    near = [{j for j, (_, q) in enumerate(rows) if j != i and (p ^ q).bit_count() <= bits} for i, (_, p) in enumerate(rows)]
    group = list(range(len(rows)))
    while True:
        new = [min([group[i], *(group[j] for j in near[i])]) for i in range(len(rows))]
        if new == group:
            break
        group = new
    ids = {}
    for (doc, _), g in zip(rows, group, strict=True):
        ids[g] = min((x for x in (ids.get(g), doc) if x is not None), default=None)
    return sorted(((doc, f"{p:016x}", ids[g], len(near[i])) for i, ((doc, p), g) in enumerate(zip(rows, group, strict=True))), key=str)


def joined(docs, **how):
    return sorted((tuple(r) for r in simhash.join(docs, **how).collect()), key=str)


def test_fingerprints_equal_plain_hashing(monkeypatch):
    texts = [t for _, t in ODD] + [rich(k, k) for k in range(1, 40)] + ["a b c", "\x1cA　b\x00c D", "ẞ É x y", "x " * 5000]
    for at_once in (7, 1 << 16):
        monkeypatch.setattr(simhash, "AT_ONCE", at_once)
        assert simhash.fingerprints(pa.array(texts), 3).tolist() == [print_of(t) for t in texts]


def test_components_and_links(spark):
    rng, docs = random.Random(4), []
    for family in range(60):
        base = rich(family, 200).split()
        for _ in range(rng.choice((1, 1, 2, 8))):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 3))):
                own[rng.randrange(len(own))] = "other"
            docs.append((len(docs), " ".join(own)))
    docs += [(5, "a short one"), (None, docs[3][1]), (None, "nobody"), (700, None), (701, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = by_force([(i, print_of(t)) for i, t in docs])
    assert joined(frame) == joined(frame, leaf=8) == want
    assert sum(r[3] for r in want) > 50


def ball(rng, size, radius):
    centre, out = rng.getrandbits(64), set()
    while len(out) < size:
        x = centre
        for k in rng.sample(range(64), rng.randrange(radius + 1)):
            x ^= 1 << k
        out.add(x)
    return out


def test_tree_finds_every_pair_once_in_balls_and_in_the_open(spark):
    """Several rounds of subtrees, families denser than any leaf, and what no ball divides."""
    rng = random.Random(6)
    x = sorted(ball(rng, 900, 2) | ball(rng, 700, 4) | {rng.getrandbits(64) for _ in range(500)} | {0, (1 << 64) - 1})
    frame = spark.createDataFrame([(int(np.array(v, np.uint64).view(np.int64)), 1 + v % 3) for v in x], "x long, copies long").repartition(4)
    found = simhash.leaves(frame, 2, 64)
    assert found.where("one != two").count() > 0 and found.where("r > 256").count() > 0
    parts = found.groupBy("r", "one", "two").applyInPandas(simhash._leaf(2), "x long, y long, links long").groupBy("x").sum("links").collect()
    a = np.array(x, np.uint64)
    near = (np.bitwise_count(a[:, None] ^ a[None]) <= 2) & ~np.eye(len(a), dtype=bool)
    links = near @ np.array([1 + v % 3 for v in x])
    assert {int(np.array(r[0], np.int64).view(np.uint64)): r[1] for r in parts} == {v: k for v, k in zip(x, links.tolist(), strict=True) if k}


def test_routing_prunes_by_the_triangle_inequality():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 20000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 20000, dtype=np.uint64)
    cuts = simhash.fit(x, 1, len(x), 1024, 2)
    held = [len(at) for _, at, _ in simhash.route(x, np.zeros(len(x), np.int64), 1, cuts, 2)]
    assert len(held) > 16 and max(held) < 4000 and sum(held) < 6 * len(x)


def test_odd_rows(odd, nothing):
    docs = [*ODD, ODD[11]]
    assert joined(odd) == by_force([(i, print_of(t)) for i, t in docs])
    assert simhash.join(nothing).count() == 0
    assert prose(5, 80) == ODD[5][1]
