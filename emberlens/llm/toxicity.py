"""A classifier chain over document labels: each linear model sees the words and the probabilities of the models before it.

Features are the presence of hashed words and of word beginnings, so that families of words share weight; each model
keeps those that separate its own classes best. Models after the first are trained with out-of-fold probabilities of
the earlier ones, as at prediction time earlier models have not seen the document either. Training takes at most
``max_train`` labelled documents, chosen by a hash of their ids (the bound is this parameter; scoring covers all
documents). A document is rejected when its last probability exceeds a threshold: the one with the best F1 score over the
out-of-fold probabilities of the training documents, halfway to the next probability, unless ``threshold`` gives one.

Defined results: a null or empty text has only the bias; null labels don't train, nor do labels without a doc_id; labels that
share a doc_id count as their largest; a very long text is hashed in one pass and keeps its distinct features; of equally
good thresholds the highest counts, and a document at the threshold is not rejected; a category without both classes gets
its base rate for all, one in a million at least; copies and repeated rows score alike; without labels all
probabilities are one in a million; an empty table
gives an empty result; ``classify`` reads no other columns, ``probabilities`` passes on those in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import mix, slices, span_hashes, text_buffers, tune, unused, word_spans

BUCKETS = 1 << 22
PREFIX_BYTES = 5


@dataclass(frozen=True)
class Settings:
    max_train: int = 6000
    folds: int = 5
    features: int = 1024  # for each category
    least: int = 5  # documents that a feature must be in
    min_score: float = 25.0  # chi-squared of a feature against the class: chance hardly reaches it among millions of buckets
    steps: int = 150
    penalty: float = 1e-3
    threshold: float | None = None


@dataclass
class Link:
    """One model of the chain: hash buckets in ascending order, their weights, those of earlier logits, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, rows: int, row: np.ndarray, bucket: np.ndarray, before: np.ndarray) -> np.ndarray:
        out = np.full(rows, self.bias) + (before @ self.earlier if before.shape[1] else 0.0)
        if len(self.buckets):
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            hit = self.buckets[at] == bucket
            out += np.bincount(row[hit], self.weights[at[hit]], minlength=rows)
        return out


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows: first, end, and distinct (row, bucket) pairs."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, row = word_spans(part, off)
        words = span_hashes(part, starts, ends, fold=True)
        heads = mix(span_hashes(part, starts, np.minimum(starts + PREFIX_BYTES, ends), fold=True))
        bucket = (np.concatenate([words, heads]) % np.uint64(BUCKETS)).astype(np.int64)
        pairs = np.unique(np.concatenate([row, row]) * BUCKETS + bucket)
        yield a, b, pairs // BUCKETS, pairs % BUCKETS


def _sample(docs: DataFrame, labels: DataFrame, categories: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels (rows by category) and the (row, bucket) pairs of the training documents, at most ``max_train``.

    Of rows that share a doc_id the one with the least hash of its text is learned from, before anything is collected."""
    known = labels.where(" AND ".join(f"{c} IS NOT NULL" for c in categories)).select("doc_id", *(F.col(c).cast("int").alias(c) for c in categories))
    chosen = known.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, bucket in features(batch.column(1)):
                lists = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(lists), pa.array(bucket.astype(np.int32))), *(x.slice(a, b - a) for x in batch.columns[2:])], names=["doc_id", "f", *categories])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")
    joined = joined.groupBy("doc_id", *categories).agg(least).select("doc_id", F.col("one.text").alias("text"), *categories)
    got = joined.mapInArrow(run, f"doc_id {kind}, f array<int>, " + ", ".join(f"{c} int" for c in categories)).toArrow().sort_by("doc_id")
    y = np.array([got[c].to_numpy() for c in categories], float).reshape(len(categories), -1)
    sizes = np.array([len(x) for x in got["f"].to_pylist()], int)
    bucket = got["f"].combine_chunks().flatten().to_numpy() if len(got) else np.empty(0, np.int64)
    return y, np.repeat(np.arange(len(sizes)), sizes), bucket.astype(np.int64)


def _fit(y: np.ndarray, use: np.ndarray, row: np.ndarray, bucket: np.ndarray, before: np.ndarray, s: Settings) -> Link:
    """A linear model on the rows in ``use``: features by their score against the class, then accelerated gradient descent."""
    n, positive = use.sum(), y[use].sum()
    if not 0 < positive < n:
        rate = min(max(positive / max(n, 1), 1e-6), 1 - 1e-6)
        return Link(np.empty(0, np.int64), np.empty(0), np.zeros(before.shape[1]), float(np.log(rate / (1 - rate))))
    own = use[row]
    kinds, where = np.unique(bucket[own], return_inverse=True)
    df, hits = np.bincount(where), np.bincount(where, y[row[own]])
    expected = df * positive / n
    value = np.where(df >= s.least, (hits - expected) ** 2 / (expected * (1 - positive / n)), 0)
    order = np.argsort(-value, kind="stable")[: s.features]
    top = np.sort(kinds[order[value[order] >= s.min_score]])
    at = np.minimum(np.searchsorted(top, bucket), max(len(top) - 1, 0))
    hit = (top[at] == bucket) & own if len(top) else np.zeros(len(bucket), bool)
    x = np.zeros((len(y), len(top) + before.shape[1] + 1), np.float32)
    x[row[hit], at[hit]] = 1
    x[:, len(top) : -1], x[:, -1] = before, 1
    x, t = x[use], y[use].astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    rate = positive / n
    w[-1] = np.log(rate / (1 - rate))
    ahead, penalty = w.copy(), np.full(len(w), s.penalty, np.float32)
    penalty[-1] = 0
    curve = np.linalg.norm(x[:: max(1, len(x) // 1000)], 2) ** 2 / len(x[:: max(1, len(x) // 1000)])
    pace = 1 / (0.25 * curve * 1.5 + s.penalty)
    for k in range(s.steps):
        error = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - t
        new = ahead - pace * (x.T @ error / len(t) + penalty * ahead)
        ahead, w = new + k / (k + 3) * (new - w), new
    return Link(top, w[: len(top)].astype(float), w[len(top) : -1].astype(float), float(w[-1]))


def _best_threshold(y: np.ndarray, logits: np.ndarray) -> float:
    """The probability between two neighbours that separates best by F1; 0.5 without both classes."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-logits, kind="stable")
    hits, value = np.cumsum(y[order]), logits[order]
    f1 = np.where(np.append(value[1:] < value[:-1], True), 2 * hits / (np.arange(1, len(y) + 1) + y.sum()), -1)
    k = int(np.argmax(f1))
    low = value[k + 1] if k + 1 < len(y) else value[k] - 1
    return float(1 / (1 + np.exp(-(value[k] + low) / 2)))


def train(docs: DataFrame, labels: DataFrame, categories: list[str], s: Settings = Settings()) -> tuple[list[Link], float]:
    """The chain's models, in the order of ``categories``, and the threshold for the last probability."""
    y, row, bucket = _sample(docs, labels, categories, s)
    n = y.shape[1]
    fold, before, chain = np.random.default_rng(n).permutation(n) % s.folds, np.empty((n, 0)), []
    for k in range(len(categories)):
        chain.append(_fit(y[k], np.ones(n, bool), row, bucket, before, s))
        if k + 1 < len(categories) or s.threshold is None:
            unseen = np.zeros(n)
            for f in range(s.folds):
                link = _fit(y[k], fold != f, row, bucket, before, s)
                unseen[fold == f] = link.logits(n, row, bucket, before)[fold == f]
            before = np.column_stack([before, np.clip(unseen, -8, 8)])
    return chain, _best_threshold(y[-1], before[:, -1]) if s.threshold is None else s.threshold


def classify(docs: DataFrame, labels: DataFrame, categories: list[str], s: Settings = Settings()) -> DataFrame:
    """doc_id, a probability for each category, and ``rejected``."""
    tune(docs.sparkSession)
    chain, threshold = train(docs, labels, categories, s)
    return probabilities(docs, chain, ["doc_id"], [f"p_{c}" for c in categories]).withColumn("rejected", F.col(f"p_{categories[-1]}") > threshold)


def probabilities(docs: DataFrame, chain: list[Link], keep: list[str], names: list[str]) -> DataFrame:
    """``keep`` columns and the probability of each link of the chain under ``names``, which ``keep`` lacks; ``text`` must be a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, bucket in features(batch.column(0)):
                before = np.empty((b - a, 0))
                for link in chain:
                    before = np.column_stack([before, np.clip(link.logits(b - a, row, bucket, before), -8, 8)])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), *(pa.array(1 / (1 + np.exp(-x))) for x in before.T)], names=[*keep, *names])

    schema = StructType([*(StructField(c, docs.schema[c].dataType) for c in keep), *(StructField(c, DoubleType()) for c in names)])
    return docs.select(F.col("text").cast("string").alias(unused(docs, "_text")[0]), *(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)
