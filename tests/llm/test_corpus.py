"""Operators over the whole corpus, against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_rows import ODD, prose, rich
from pyspark.sql import functions as F

from emberlens.llm import common, jaccard, language_model, lines, pieces, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def held_column():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


SMALL = language_model.Settings(least=12, most=12, width=8, noise=16, batch=64, rounds=2)


def test_language_model_base_counts(odd, nothing):
    docs = [*ODD, ODD[11]]
    tokens = [(i, [*words(t), None]) for i, t in docs]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    rows = defaultdict(list)
    for r in language_model.score(odd, held_column(), SMALL).collect():
        rows[r.doc_id].append(r)
    for i, ws in tokens:
        for r in rows[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ws), sum(c[w] > 0 for w in ws), n)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
            assert r.score < 0
    assert language_model.score(nothing, held_column(), SMALL).count() == 0


def test_language_model_learns_and_is_normalised(spark):
    rng = random.Random(3)
    follow = {w: rng.sample("abcdefgh", 2) for w in "abcdefgh"}

    def text():
        out = [rng.choice("abcdefgh")]
        while len(out) < 60:
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    texts = [(i, text()) for i in range(1500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    s = language_model.Settings(least=16, most=16, width=16, noise=16, batch=64)
    rows = [r for r in language_model.score(docs, held_column(), s).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.7 * sum(r.base_score for r in rows)
    # other partitions, the same scores
    other = {r.doc_id: r.score for r in language_model.score(docs.repartition(7), held_column(), s).collect()}
    assert all(math.isclose(other[r.doc_id], r.score, rel_tol=1e-6) for r in rows)
    # several shards learn the same
    several = language_model.Settings(least=16, most=16, width=16, noise=16, batch=64, shard_tokens=8000)
    rows = [r for r in language_model.score(docs, held_column(), several).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)
    unigram = np.full(5, 0.2)
    model = language_model.Model(unigram, s)
    left, right = model.context_tables()
    z = language_model.normalisers(spark, model)
    logits = left[2] + right[3]
    assert np.allclose(np.exp(logits @ model.q.T + model.b - z[2, 3]).sum(), 1, atol=1e-5)


def test_language_model_sums_meet_in_a_tree(spark, monkeypatch):
    """Seven shards in pairs, pairs of pairs and so on, or at once: the same average up to rounding."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(40))) for i in range(120)], "doc_id long, text string").repartition(3)
    settings = language_model.Settings(least=12, most=12, width=8, noise=16, batch=64, rounds=1, shard_tokens=600)
    scores = []
    for fan in (2, 32):
        monkeypatch.setattr(language_model, "FAN", fan)
        scores.append({r.doc_id: r.score for r in language_model.score(docs, F.lit(False), settings).collect()})
    assert scores[0].keys() == scores[1].keys() and all(math.isclose(x, scores[1][i], rel_tol=1e-4) for i, x in scores[0].items())


def components_by_force(docs, percent=75):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        inter = len(sets[a] & sets[b])
        if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies():
    rng, docs = random.Random(9), []
    passage = prose(99, 60)
    for g in range(12):
        text = prose(1000 + g, rng.choice((20, 60, 150))).split(" ")
        for _ in range(rng.choice((1, 2, 5, 14))):
            own = list(text)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(("new", "words", "here"))
            docs.append(" ".join(own))
    docs += [passage + " " + prose(2000 + k, 30) for k in range(25)] + [passage + f" w{k}" for k in range(8)]
    rng.shuffle(docs)
    return list(enumerate(docs))


def links_by_force(docs, percent=75):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    near = lambda a, b: bool(a & b) and 100 * len(a & b) >= percent * len(a | b)
    return {i: sum(near(a, b) for j, b in sets.items() if j != i) for i, a in sets.items()}


def joined(spark, docs, **how):
    return jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), **how).collect()


@pytest.mark.parametrize(("common", "leaf_rows", "leaf_shingles"), [(16, 1024, 1 << 20), (2, 1024, 1 << 20), (1, 24, 1 << 20), (1, 6, 1 << 20), (2, 1024, 900)])
def test_jaccard_components_and_links(spark, common, leaf_rows, leaf_shingles):
    docs = near_copies()
    rows = joined(spark, docs, common=common, leaf_rows=leaf_rows, leaf_shingles=leaf_shingles)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components_by_force(docs)
    assert {r.doc_id: r.n_links for r in rows} == links_by_force(docs)


@pytest.mark.parametrize("leaf_rows", [1024, 40])
def test_jaccard_large_family(spark, leaf_rows):
    # copies, near copies and texts that fall short of the similarity, around three bases that share a passage
    rng, docs = random.Random(12), []
    passage = prose(77, 60).split()
    for base in range(3):
        own = passage + rich(base, 60).split()
        for _ in range(90):
            text = list(own)
            for _ in range(rng.choice((0, 1, 2, 4, 8))):
                text[rng.randrange(len(text))] = rng.choice("abcdef")
            docs.append(" ".join(text))
    docs = list(enumerate(docs))
    rows = joined(spark, docs, leaf_rows=leaf_rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components_by_force(docs)
    assert {r.doc_id: r.n_links for r in rows} == links_by_force(docs)


def test_voronoi_regions_separate_what_merely_shares_a_passage(spark):
    # chains of texts hang together by common shingles, while their ends have nothing in common
    rng, stock = random.Random(3), [rich(500 + k, 40) for k in range(40)]
    docs = list(enumerate(f"{stock[k]} {stock[(k + 1) % 40]} x{rng.randrange(3)}" for k in range(40) for _ in range(12)))
    rows = joined(spark, docs, common=1, leaf_rows=60)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components_by_force(docs)
    assert {r.doc_id: r.n_links for r in rows} == links_by_force(docs)


def test_pivots_cut_a_family_into_regions_again_and_again(spark, monkeypatch):
    # groups of near copies far from each other, held together by a few texts of two halves
    rng, bases = random.Random(4), [rich(900 + k, 80).split() for k in range(6)]
    docs = []
    for base in bases:
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(80)] = rng.choice("abcdef")
            docs.append(" ".join(own))
    docs += [" ".join(bases[k][:40] + bases[k + 1][40:]) for k in range(5)]
    docs = list(enumerate(docs))
    seen, write = [], jaccard.materialize

    def watched(df, name):
        out = write(df, name)
        if name in ("jaccard-sizes", "jaccard-dense"):
            seen.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard, "materialize", watched)
    rows = joined(spark, docs, common=1, leaf_rows=70)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components_by_force(docs)
    assert {r.doc_id: r.n_links for r in rows} == links_by_force(docs)
    # one family became several regions, and not by tiles
    assert seen[0] == ("jaccard-sizes", 1) and seen[1] == ("jaccard-dense", 0) and seen[2][0] == "jaccard-sizes" and seen[2][1] > 2


def test_leaf_links_equal_brute_force():
    rng = np.random.default_rng(8)
    lists = [np.unique(np.concatenate([rng.integers(0, 40, 30), rng.integers(100, 100 + 30 * (k % 3 + 1), 6)])) for k in range(150)]
    guest, copies = rng.integers(0, 4, 150), rng.integers(1, 5, 150)
    links, part = jaccard.links_within(lists, guest, copies, 30, rows=64)
    near = np.array([[i != j and not guest[i] & guest[j] and 100 * len(a := np.intersect1d(x, y)) >= 30 * (len(x) + len(y) - len(a)) for j, y in enumerate(lists)] for i, x in enumerate(lists)])
    assert links.tolist() == (near @ copies).tolist() and near.any()
    root = np.arange(150)
    for _ in range(150):
        root = np.array([min([root[i], *root[near[i]]]) for i in range(150)])
    assert part.tolist() == root.tolist()


def test_jaccard_odd_rows(spark, odd, nothing):
    rows = jaccard.join(odd).collect()
    assert len(rows) == len(ODD) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components_by_force(ODD)
    assert next(r.n_links for r in rows if r.doc_id == 11) == 1
    assert jaccard.join(nothing).count() == 0
    nulls = spark.createDataFrame([(None, prose(5, 80)), (None, prose(9, 40)), (4, prose(5, 80)), (4, prose(10, 40))], "doc_id long, text string")
    assert Counter((r.doc_id, r.component_id, r.n_links) for r in jaccard.join(nulls).collect()) == Counter([(None, 4, 1), (None, None, 0), (4, 4, 1), (4, 4, 0)])


def test_rows_that_share_an_id_are_read_once_each(spark):
    """Every row without an id is wanted: linear in the rows, not in their square."""
    base = rich(1, 60).split()
    docs = [(None if k % 2 else 7, " ".join([*base[:40], f"own{k // 3}", *base[41:50], f"tail{k}"])) for k in range(240)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    named = jaccard.classes(frame, 5)
    wanted = named.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    sets = jaccard._sets(frame, wanted, 5)
    assert sets.count() == 240
    rows = jaccard.join(frame).collect()
    grams = [frozenset(zip(*(w[i:] for i in range(5)), strict=False)) for w in (words(t) for _, t in docs)]
    links = [sum(j != i and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(grams)) for i, a in enumerate(grams)]
    assert Counter((r.doc_id, r.n_links) for r in rows) == Counter((i, k) for (i, _), k in zip(docs, links, strict=True))


def test_copies_in_many_tasks_are_one_set(spark, monkeypatch):
    seen, regions = [], jaccard.regions
    monkeypatch.setattr(jaccard, "regions", lambda docs, n, percent, most, common, buckets: seen.append(len(common)) or regions(docs, n, percent, most, common, buckets))
    rows = jaccard.join(spark.createDataFrame([(k, rich(40 + k % 3, 60)) for k in range(60)], "doc_id long, text string").repartition(12), common=2).collect()
    assert seen == [0] and {r.doc_id: (r.component_id, r.n_links) for r in rows} == {k: (k % 3, 19) for k in range(60)}


def test_texts_are_not_shuffled_for_their_sets(spark):
    frame = spark.createDataFrame([(k, rich(k, 60)) for k in range(20)], "doc_id long, text string")
    wanted = jaccard.classes(frame, 5).where("doc_id % 5 = 0").select("class", "doc_id")
    sets = jaccard._sets(frame, wanted, 5)
    below = sets._jdf.queryExecution().executedPlan().toString().split("MapInArrow", 1)[1]
    assert "SortMergeJoin" not in below and sets.count() == 4


def test_entries_are_sent_in_few_bytes_however_many_buckets(spark, monkeypatch):
    frame, sent = spark.createDataFrame([(k, rich(k, 2000)) for k in range(60)], "doc_id long, text string").coalesce(1), []
    deal = type(frame).repartitionById
    monkeypatch.setattr(type(frame), "repartitionById", lambda self, n, c: sent.append(self.collect()) or deal(self, n, c))
    jaccard.regions(frame, 5, 75, 8, np.empty(0, np.uint32), 32)
    entries = sum(int(jaccard.boundary(np.array([r.n_shingles]), 75)[0]) for r in jaccard.classes(frame, 5).collect())
    assert sum(len(v) for r in sent[0] for v in r if isinstance(v, (bytes, bytearray))) < 12 * entries


@pytest.mark.parametrize("kind", ["u1", "u4", "u8"])
def test_packed_integers_come_back(kind):
    rng = np.random.default_rng(5)
    for n in (1, 2, 1000):
        for top in (1, 200, np.iinfo(kind).max):
            values = rng.integers(0, top, n, dtype=kind, endpoint=True)
            assert (common.unpacked(common.packed(values), kind) == values).all()


def lines_by_force(docs, least):
    seen, out = {}, {}
    for i, t in sorted(docs):
        full = [(k, x, len(WORD.findall(x))) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        gone = set()
        for a in range(len(full)):
            for b in range(a + 1, len(full) + 1):
                if sum(x[2] for x in full[a:b]) >= least:
                    key = tuple(x[1] for x in full[a:b])
                    doc, at = seen.setdefault(key, (i, a))
                    if (doc, at) != (i, a):
                        # the first occurrence stays whole, where a later one overlaps it too
                        gone |= {x[0] for x in full[max(a, at + b - a) if doc == i else a : b]}
        out[i] = gone
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    stock = [" ".join(prose(k, rng.choice((1, 2, 3, 8))).split()) for k in range(14)]
    docs = [(i, "\n".join(rng.choice([*stock, "", f"own line {i}"]) for _ in range(rng.randrange(0, 14)))) for i in range(40)]
    docs += [(100, docs[3][1]), (101, docs[3][1] + "\nmore"), (102, "\n".join([stock[3]] * 9))]
    expected = lines_by_force(docs, 6)
    rows = lines.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), min_words=6).collect()
    for r in rows:
        kept = [x for k, x in enumerate(dict(docs)[r.doc_id].split("\n")) if k not in expected[r.doc_id]]
        assert (r.text, r.n_deleted) == ("\n".join(kept), len(expected[r.doc_id]))
    assert sum(map(len, expected.values())) > 20


def test_line_dedup_of_text_that_repeats_itself(spark):
    """What stays, worked out by hand: the first run of enough words, in periods of one line, of three, and at a distance."""
    line = lambda c, n=10: " ".join([c] * n)
    periods = {1: [line("a")] * 6, 2: [line(c, 20) for c in "abc"] * 4, 3: [line(c) for c in "xyz"] * 4, 4: [line("p"), line("q")] * 2 + ["own words"] + [line("p"), line("q")] * 2, 5: [line("r", 60)] * 3}
    kept = {1: periods[1][:5], 2: periods[2][:3], 3: periods[3][:5], 4: periods[4], 5: periods[5][:1]}
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in periods.items()], "doc_id long, text string")
    assert {r.doc_id: r.text.split("\n") for r in lines.dedup(docs, min_words=50).collect()} == kept


def test_line_dedup_odd_rows(odd, nothing):
    rows = lines.dedup(odd)
    assert Counter(rows.columns) == Counter(odd.columns)  + Counter(["n_deleted"])
    got = rows.collect()
    assert len(got) == len(ODD) + 1 and next(r for r in got if r.doc_id == 0).text is None
    assert sorted(r.n_deleted > 0 for r in got if r.doc_id == 11) == [False, True]
    assert lines.dedup(nothing).count() == 0


def test_line_dedup_keeps_columns_named_as_its_own(spark):
    docs = [(None, "a b c\nd e f"), (7, "a b c\nd e f"), (7, "x\na b c\nd e f"), (3, None)]
    rows = spark.createDataFrame([(i, t, k, [k], "s") for k, (i, t) in enumerate(docs)], "doc_id long, text string, _uid int, _gone array<int>, _split string")
    got = sorted(lines.dedup(rows, min_words=6).collect(), key=lambda r: r["_uid"])
    assert [(r["_gone"], r["_split"]) for r in got] == [([k], "s") for k in range(4)]
    assert [(r.text, r.n_lines, r.n_deleted) for r in got] == [("", 2, 2), ("a b c\nd e f", 2, 0), ("x", 3, 2), (None, 0, 0)]


def test_line_dedup_of_a_long_document_is_linear(spark):
    body = "\n".join(f"line {k} of the long text" for k in range(60_000))
    rows = lines.dedup(spark.createDataFrame([(1, body), (2, "own start\n" + body + "\nown end")], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_deleted, len(r.text)) for r in rows} == {1: (0, len(body)), 2: (60_000, len("own start\nown end"))}


def top_by_force(rows, k):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v[i] = [math.floor(1024 * float(np.float32(c))) for c in x]
    out = set()
    for q in v:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v[q], v[o], strict=False)), o) for o in v if o != q)
            out |= {(q, n + 1, o, -s) for n, (s, o) in enumerate(scored[:k])}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice((0.1, 1, 5))]) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]
    rows += [(2000, None), (2001, [1.0, None]), (2100, [float("nan")] * 8), (2200, [float("inf")] * 8), (2300, []), (2301, [3.0, 4.0]), (2400, [1e6] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).repartition(5)
    for block in (2048, 4):
        got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, lambda c: c % 100 == 0, k=10, block_queries=block).collect()}
        assert got == top_by_force(rows, 10)
    assert topk.search(df.where("vec_id < 0"), lambda c: c % 100 == 0).count() == 0
    assert topk.search(df.where("vec_id < 3"), lambda c: c % 100 == 0).count() == 2


def test_top_k_of_queries_that_share_an_id(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), *((k, [k / 10, 1 - k / 10]) for k in range(1, 8))]
    got = Counter((r.query_id, r["rank"], r.vec_id) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), lambda c: c % 100 == 0, k=2).collect())
    assert got == Counter([(100, 1, 7), (100, 2, 6), (100, 1, 1), (100, 2, 2)])


def test_top_k_of_mixed_norms_in_many_files(spark):
    # the long vectors have fewer components, so their files are smaller and read after those of the short ones
    rng = np.random.default_rng(4)
    v = np.floor(1024 * rng.normal(size=(6000, 8)) * rng.lognormal(0, 2, size=(6000, 1)))
    v[(v**2).sum(1) > np.median((v**2).sum(1)), 3:] = 0
    df = spark.createDataFrame([(i, np.trim_zeros(x / 1024, "b").tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    own = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.minPartitionNum": "1"}
    before = {key: spark.conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, lambda c: c % 100 == 0, k=10).collect()}
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    expected = set()
    for q in range(0, 6000, 100):
        scores = v @ v[q]
        best = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:10]
        expected |= {(q, n + 1, i, int(-s)) for n, (s, i) in enumerate(best)}
    assert got == expected


def test_toxicity_trains_on_a_bounded_sample(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(k, f"other {k}") for k in range(2, 60)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(60)] + [(None, 1, 1), (1, 1, 0)], "doc_id long, low int, toxic int")
    for most in (10, 100):
        y, row, _ = toxicity._sample(docs, labels, ["low", "toxic"], toxicity.Settings(max_train=most))
        assert y.shape[0] == 2 and y.shape[1] <= min(most, 59) and row.max() < y.shape[1]
    # labels of one id count as their largest, and one of its 500 texts is learned from
    assert y.shape[1] == 59 and y[0].sum() == 1


def test_toxicity_models_are_the_optimum_and_score_as_written(spark):
    """Probabilities from the chain by hand, the threshold among all, and no better weights near those found."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [prose(900 + k, 40) + (" vile" if k % 4 == 0 else "") + (" junk" if k % 3 == 0 else "") for k in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 4 == 0)) for k in range(200)], "doc_id long, low int, toxic int")
    s = toxicity.Settings(steps=3000)
    chain, threshold = toxicity.train(docs, labels, ["low", "toxic"], s)
    rows = {r.doc_id: r for r in toxicity.classify(docs, labels, ["low", "toxic"], s).collect()}
    held = []
    for k, text in enumerate(texts):
        own = {int(b) for _, _, _, bucket in toxicity.features(pa.array([text])) for b in bucket}
        z = []
        for link in chain:
            z.append(link.bias + sum(w for b, w in zip(link.buckets.tolist(), link.weights.tolist(), strict=True) if b in own) + sum(min(max(x, -8), 8) * w for x, w in zip(z, link.earlier.tolist(), strict=True)))
        held.append((own, z))
        p = [1 / (1 + math.exp(-min(max(x, -8), 8))) for x in z]
        assert math.isclose(rows[k].p_low, p[0], rel_tol=1e-9) and math.isclose(rows[k].p_toxic, p[1], rel_tol=1e-9) and rows[k].rejected == (p[1] > threshold)
    first, y = chain[0], np.array([k % 3 == 0 for k in range(200)])
    x = np.array([[b in own for b in first.buckets.tolist()] for own, _ in held[:200]], float)
    loss = lambda w, b: np.logaddexp(0, -(2 * y - 1) * (x @ w + b)).mean() + s.penalty / 2 * (w**2).sum()
    best = loss(first.weights, first.bias)
    assert all(loss(first.weights + d, first.bias + e) > best - 1e-6 for d, e in ((rng.normal(0, 0.05, len(first.weights)), rng.normal(0, 0.05)) for _ in range(200)))
    for n in (2, 5, 40):
        z, t = rng.normal(size=n).round(1), rng.random(n) < 0.4
        t[:2] = True, False
        f1 = lambda q: 2 * (t & (z > q)).sum() / max((z > q).sum() + t.sum(), 1)  # noqa: B023, E731
        got = toxicity._best_threshold(t.astype(float), z)
        assert math.isclose(f1(math.log(got / (1 - got))), max(f1(q) for q in [*z, z.min() - 1]))


def test_toxicity_chain(spark, odd, nothing):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(600):
        toxic, low = i % 5 == 0, i % 3 == 0
        text = prose(5000 + i, 60) + (" " + rng.choice(("vileness", "vilenesses", "Vile")) if toxic else "") + (" junk" if low else "")
        docs.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(low), int(toxic)))
    labels.append((1, None, 1))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, low int, toxic int")
    rows = toxicity.classify(d, lab, ["low", "toxic"]).collect()
    wrong = sum(r.rejected != (r.doc_id % 5 == 0) for r in rows)
    assert len(rows) == 600 and wrong <= 6
    out = toxicity.classify(odd, lab, ["low", "toxic"]).collect()
    assert len(out) == len(ODD) + 1
    assert toxicity.classify(nothing, lab, ["low", "toxic"]).count() == 0
    clash = odd.select("doc_id", "text", F.lit(7).alias("_text"), F.lit("x").alias("p_toxic"))
    chain, _ = toxicity.train(d, lab, ["low", "toxic"])
    kept = toxicity.probabilities(clash, chain, clash.columns, ["_low", "_toxic"])
    assert kept.columns == [*clash.columns, "_low", "_toxic"] and {(r["_text"], r.p_toxic) for r in kept.collect()} == {(7, "x")}
    assert not any(r.rejected for r in toxicity.classify(odd, lab.where("doc_id < 0"), ["low", "toxic"]).collect())


def model_path():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_round_trip_and_chunks(spark, odd, nothing):
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=model_path())
    for chunk in (40, 1 << 15):
        rows = pieces.encode(odd, model_path(), chunk_chars=chunk)
        got = rows.collect()
        assert len(got) == len(ODD) + 1 and any(r.n_chunks > 1 for r in got) == (chunk == 40)
        for r in got:
            text = dict(ODD)[r.doc_id] or ""
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == tool.encode(text)
            assert r.text_crc32 == zlib.crc32(text.encode())
        assert {r.doc_id: r.text for r in pieces.decode(rows, model_path(), ["doc_id"]).collect()} == {i: t or "" for i, t in ODD}
    assert pieces.encode(nothing, model_path()).count() == 0


def test_max_plus_scan_equals_the_library(spark, odd, nothing):
    import sentencepiece

    with open(model_path(), "rb") as f:
        raw = pieces.read_as(f.read(), pieces.UNIGRAM)
    tool = sentencepiece.SentencePieceProcessor(model_proto=raw)
    own = pieces.Pieces(raw)
    assert own.kind == pieces.UNIGRAM

    def total(ids):
        return sum(own.tool.get_score(i) for i in ids if not own.tool.is_byte(i))

    endless = "".join(random.Random(5).choice("abcdeé") for _ in range(900))
    texts = {**dict(ODD[:8]), 11: ODD[11][1], 20: endless, 21: f"some words {endless}  and {prose(8, 400)} {endless[:300]} end ", 22: " " * 700, 23: "é😀" * 300}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for chunk in (50, 300):
        rows = pieces.encode(docs, model_path(), chunk_chars=chunk, kind=pieces.UNIGRAM)
        got = rows.collect()
        assert len(got) == len(texts) and max(r.n_chunks for r in got) > 3
        for r in got:
            text, ids = texts[r.doc_id] or "", np.frombuffer(bytes(r.ids), "<u4").tolist()
            best = total(tool.encode(text))  # the library adds in 32 bits
            assert tool.decode(ids) == text and math.isclose(total(ids), best, rel_tol=1e-5, abs_tol=1e-4)
        assert {r.doc_id: r.text for r in pieces.decode(rows, model_path(), ["doc_id"]).collect()} == {i: t or "" for i, t in texts.items()}
    assert pieces.encode(nothing, model_path(), kind=pieces.UNIGRAM).count() == 0


def test_giant_text_through_the_query(spark, tmp_path):
    from emberlens.llm import queries

    body = " ".join(prose(k, 400) for k in range(60)) + " " + "".join(random.Random(6).choice("xyz") for _ in range(80_000))
    spark.createDataFrame([(1, body), (2, None), (3, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op8_sentencepiece(spark, str(tmp_path)).collect()}
    assert len(body) > 200_000 and rows[1].n_chunks >= 5 and all(r.round_trip for r in rows.values()) and rows[2].n_ids == 0


def test_max_plus_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = rng.normal(size=(3, 5, 5))
    f = pieces.Pieces.combine
    assert np.allclose(f(f(a, b), c), f(a, f(b, c)))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    copy = prose(1, 200).replace("\n", " ")
    rows = [(0, copy, "en", "s", 0), (1, copy + " end", "en", "s", 0), (2, "password=abcdef123 " + prose(2, 60), "en", "s", 0), (3, None, "en", "s", 0), (4, prose(3, 90), "fr", None, 0), (5, prose(3, 90), "fr", None, 0)]
    rows += [(10 + i, prose(100 + i, 60) + (" vileness" if i % 4 == 0 else ""), "en", "s", 0) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10 + i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {i for i, *_ in rows if i < 10 or (i - 10) % 4}
    assert kept[0] == clean and kept[1] == clean - {5} and kept[2] == clean - {1, 5} and kept[3] == kept[4] == kept[2]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/out3").collect()}
    assert "abcdef123" not in texts[2] and texts[3] is None and texts[4] == prose(3, 90)


def test_pipeline_runs_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    extra = "_uid long, _gone string, _split string, _text string, p_toxic double, p_low_quality double, n_lines long, n_deleted long, kept long, rank long, h string, class long"
    columns = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    values = (7, "g", "s", "t", 0.5, 0.25, 3, 4, 5, 6, "h", 8)
    body = "\n".join(f"line {k} of a long text" for k in range(20_000))
    rows = [(None, "no id here", "en", None, 0), *((i, t, None, "s", 0) for i, t in ODD), (11, ODD[11][1], "en", "s", 0), (20, body, "en", "s", 0), (21, prose(21, 70), "en", "s", 0), (21, prose(22, 70), "en", "s", 0)]
    for name, held in (("odd", rows), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame([(*r, *values) for r in held], columns).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(5, None, 1), (7, 1, 0)][: len(held)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(f"{folder}/out{k}")
            docs = spark.read.parquet(f"{folder}/out{k}")
            if k < 4:
                assert docs.columns == [c.split()[0] for c in columns.split(", ")]
                assert all(tuple(r)[5:] == values for r in docs.collect())
        assert corpus_pipeline.run(spark, folder).count() == docs.count()
        ids = [r.doc_id for r in spark.read.parquet(f"{folder}/out3").collect()]
        # one of each group of copies stays, and so does a document with neither text nor words; 8 lost the lines that it shares with 5
        first = {8} | {i for i, (_, root) in components_by_force(ODD).items() if i == root}
        assert Counter(ids) == (Counter([*first, None, 20, 21, 21]) if held else Counter())


@pytest.mark.parametrize("name", ["op3_jaccard_join", "op5_norm_sorted_topk"])
def test_query_equals_its_sql(spark, name):
    import os

    import duckdb

    from emberlens.llm import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables here")
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    expected = db.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(expected.columns)
    assert sorted(tuple(r[c] for c in expected.columns) for r in got.collect()) == sorted(expected.fetchall())


def test_near_copies_stage_shuffles_marked_texts_only(spark):
    import corpus_pipeline

    rows = [(None if k == 7 else k // 2, rich(k % 9 + 300, 60)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    found = {r.doc_id for r in jaccard.join(docs).collect() if r.doc_id == r.component_id}
    assert Counter(map(tuple, out.collect())) == Counter(r for r in rows if r[0] in found) and found
    first, second = out._jdf.queryExecution().optimizedPlan().toString().split("Union", 1)[1].split("\n+- ", 1)
    assert "LeftAnti" not in first and "LeftSemi" not in first and "LeftAnti" in second


def test_marks_hold_every_wanted_row_and_few_others(spark):
    ids = [*range(0, 3000, 7), None]
    rows = common.marked(spark.createDataFrame([(k, k) for k in [*range(3000), None]], "doc_id long, at long"), "doc_id", spark.createDataFrame([(k,) for k in ids], "id long"), "mark").collect()
    hit = {r["doc_id"] for r in rows if r["mark"]}
    assert len(rows) == 3001 and hit >= set(ids) and len(hit) < len(ids) + 10


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
