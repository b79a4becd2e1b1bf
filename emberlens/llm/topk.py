"""Exact top-k inner products: vectors by descending length, rotated so that partial sums say most, pruned by bounds.

Vectors become integers, so scores are exact. An SVD of the whole table (its Gram matrix is summed over all partitions)
gives a rotation under which the first coordinates hold most of the length. Vectors are range-partitioned and sorted by
descending norm; a task may read several such runs in any order, so blocks are cut where norms rise. For a block of
vectors and a block of queries: the product of the largest norms bounds every score, and a block whose bound is under
every query's k-th score is skipped; else partial sums over the leading coordinates plus the Cauchy-Schwarz product of
the residual norms leave few pairs, whose exact integer products are taken. Each query's
first k-th score comes from the longest vectors of all. Queries are taken in blocks of bounded size, each block sent
to every partition; a partition returns at most k rows for a query, ranked again over all.

Defined results: vectors that are null or hold null or non-finite components take no part, neither as queries nor as
candidates; shorter vectors count as padded with zeros and an empty vector as zeros; equal scores go to smaller ids;
rows that repeat an id are separate queries, each with its own result, and separate candidates except for queries of that id; fewer candidates than k give fewer rows;
an empty table gives an empty result; other columns are not read. Components are scaled and floored as doubles; beyond
2**20 the products leave float64's exact range and are taken with Python integers, clipped to 64 bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tune

BLOCK = 512
EXACT = 1 << 20


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of float64 integers, padded to ``width``."""
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _rows(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a table of the two columns."""
    parts = [(b.column(0).to_numpy(), _matrix(b.column(1), width)) for b in table.to_batches() if len(b)]
    return (np.concatenate([p[k] for p in parts]) for k in range(2)) if parts else (np.empty(0, np.int64), np.empty((0, width)))


def _integers(vectors: DataFrame, id_col: str, column: str, scale: int) -> DataFrame:
    """id, v (scaled, floored) and the squared norm of each row that takes part."""
    x = F.col(column)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("double"))
    rows = vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for g in batch.column(0).to_pylist():
                total += np.frombuffer(g).reshape(width, width)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    parts = rows.select("v").mapInArrow(run, "g binary")
    few = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
    return sum(np.frombuffer(r.g).reshape(width, width) for r in parts.repartition(few).mapInArrow(add, "g binary").collect())


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort([ids, -scores.astype(np.float64) if scores.dtype != object else np.array([-x for x in scores], object)])[:k]
    return scores[order], ids[order]


def _blocks(norms: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most BLOCK rows, none across a rise of the norms."""
    edges = [0, *(np.flatnonzero(np.diff(norms) > 0) + 1).tolist(), len(norms)]
    for a, b in itertools.pairwise(edges):
        for at in range(a, b, BLOCK):
            yield at, min(at + BLOCK, b)


class _Search:
    """One query block's state in one partition."""

    def __init__(self, ids, q, rotation, lead, k, floor) -> None:
        self.ids, self.q, self.k, self.lead, self.rotation = ids, q, k, lead, rotation
        turned = q @ rotation
        self.head, self.tail = turned[:, :lead], np.sqrt((turned[:, lead:] ** 2).sum(1))
        self.norm = np.sqrt((q**2).sum(1))
        self.least = floor.astype(float)  # k-th best score so far
        self.big = bool(len(q)) and np.abs(q).max() > EXACT
        self.top: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(ids)

    def live(self, longest: float) -> np.ndarray:
        """The queries for which a vector of at most this norm can matter."""
        return np.flatnonzero(self.norm * longest * (1 + 1e-9) + 1 >= self.least)

    def block(self, ids: np.ndarray, v: np.ndarray, live: np.ndarray) -> None:
        """Take a block's best scores with the ``live`` queries."""
        turned = v @ self.rotation
        tail = np.sqrt((turned[:, self.lead :] ** 2).sum(1))
        bound = self.head[live] @ turned[:, : self.lead].T + np.outer(self.tail[live], tail)
        bound += 1 + 1e-9 * np.outer(self.norm[live], np.sqrt((v**2).sum(1)))
        hit_q, hit_v = np.nonzero(bound >= self.least[live][:, None])
        if not len(hit_q):
            return
        hit_q = live[hit_q]
        if self.big or np.abs(v).max() > EXACT:
            scores = np.array([sum(int(a) * int(b) for a, b in zip(self.q[i], v[j], strict=True)) for i, j in zip(hit_q, hit_v, strict=True)], object)
            scores = np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in scores], object)
        else:
            used = np.unique(hit_q)
            exact = self.q[used] @ v.T
            scores = exact[np.searchsorted(used, hit_q), hit_v]
        other = ids[hit_v] != self.ids[hit_q]
        hit_q, hit_v, scores = hit_q[other], hit_v[other], scores[other]
        cuts = np.flatnonzero(np.diff(hit_q)) + 1
        for part in np.split(np.arange(len(hit_q)), cuts):
            if not len(part):
                continue
            i = hit_q[part[0]]
            s, d = _best(np.concatenate([self.top[i][0], scores[part]]), np.concatenate([self.top[i][1], ids[hit_v[part]]]), self.k)
            self.top[i] = s, d
            if len(s) == self.k:
                self.least[i] = max(self.least[i], float(s[-1]))


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", column: str = "embedding", scale: int = 1024, block_queries: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best other rows."""
    spark = vectors.sparkSession
    tune(spark)
    ints = materialize(_integers(vectors, id_col, column, scale).withColumn("draw", F.xxhash64("id")), "topk-rows")
    facts = ints.agg(F.max(F.size("v")).alias("w"), F.count("*").alias("n")).first()
    width = max(facts.w or 0, 1)
    by_norm = ints.repartitionByRange(F.desc("norm2"), "draw").sortWithinPartitions(F.desc("norm2"), "draw").select("id", "v", "norm2")
    ordered = materialize(by_norm, "topk-order")
    gram = _gram(ordered, width)
    values, turn = np.linalg.eigh(gram)
    rotation = turn[:, ::-1]
    shares = np.cumsum(np.maximum(values[::-1], 0)) / max(np.maximum(values, 0).sum(), 1e-300)
    lead = int(min(width, max(1, np.searchsorted(shares, 0.8) + 1)))
    longest = ints.orderBy(F.desc("norm2"), "id").limit(8 * BLOCK).select("id", "v").toArrow()
    seed_ids, seed = _rows(longest, width)
    out = None
    queries = ints.where(is_query(F.col("id"))).select("id", "v")
    count = queries.count()
    blocks = max(1, -(-count // block_queries))
    for number in range(blocks):
        own = queries.where(F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)) == number) if blocks > 1 else queries
        got = own.toArrow()
        q_ids, q = _rows(got, width)
        floor = np.full(len(q), -np.inf)
        if len(seed) > k and len(q) and max(np.abs(q).max(), np.abs(seed).max()) <= EXACT:
            products = q @ seed.T
            products[q_ids[:, None] == seed_ids] = -np.inf
            floor = np.partition(products, -k, axis=1)[:, -k]
        sent = spark.sparkContext.broadcast((q_ids, q, rotation, lead, floor))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            q_ids, q, rotation, lead, floor = sent.value
            state = _Search(q_ids, q, rotation, lead, k, floor)
            for batch in batches:
                norms = np.sqrt(batch.column(2).to_numpy())
                for a, b in _blocks(norms):
                    if len(live := state.live(norms[a:b].max())):
                        part = batch.slice(a, b - a)
                        state.block(part.column(0).to_numpy(), _matrix(part.column(1), width), live)
            rows, qs, vs, ss = ([], [], [], [])
            for i, (s, d) in enumerate(state.top):
                rows += [number << 32 | i] * len(s)
                qs += [q_ids[i]] * len(s)
                vs += d.tolist()
                ss += [int(x) for x in s]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, qs, vs, ss)], names=["query_row", "query_id", "vec_id", "score"])

        found = ordered.mapInArrow(run, "query_row long, query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            best = materialize(best, "topk-block")
        out = best if out is None else out.unionByName(best)
    return out
