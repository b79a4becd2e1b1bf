"""A log-bilinear language model, trained in numpy with noise-contrastive estimation, that scores whole documents.

The two words before a token give a context vector ``R[w2] @ C2 + R[w1] @ C1``; its product with the output vectors
``Q`` plus a bias are logits over the model's vocabulary: the most frequent training words, the end of a text, and one
class for all other words, which shares its mass by add-one counts. So every text has a normalised probability.

All counting covers the whole corpus. Words are 64-bit hashes; counts go through one aggregation. The vocabulary grows
with the root of the number of distinct training words, up to ``most`` classes: the table of normalisers, one for each pair
of context words, has the square of that many entries. Training makes ``rounds`` passes, each over its own part of the
documents. A pass deals documents to shards of about ``shard_tokens`` tokens by a hash of what they hold and of their
doc_id, and each shard is read once, in the order of that hash, from common parameters, which are averaged after the pass
by a two-level tree: so the model depends on the rows alone, not on how they lie in files, and large and small corpora
are read alike. Normalisers of all context pairs come from batched
matrix products in one small job, after which scoring looks them up. Words above a share of 2**-18 of all tokens (at
most 2**18 of them, so the table has a size bound) are counted while reading; the rest are joined with the counts by
hash, so that no key of that join is frequent.

Defined results: a null or empty text is one end token; copies and repeated rows are scored separately; without
training tokens the model is uniform; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, span_hashes, text_buffers, tune, word_spans

END = np.uint64(0x5DEECE66D)  # the end token's place among word hashes
HEAVY = 1 << 18
READ_TOKENS = 1 << 18  # tokens that training shuffles at once
FAN = 32  # sums that a task adds


@dataclass(frozen=True)
class Settings:
    least: int = 1024  # classes, with the end token and the class of other words
    most: int = 4096
    width: int = 32
    noise: int = 64
    batch: int = 512
    rounds: int = 3
    shard_tokens: int = 1 << 21
    rate: float = 0.6
    seed: int = 5


def tokens_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows: first row, end row, the token hashes with ends, and the offset of each row's tokens."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, row = word_spans(part, off)
        words = np.bincount(row, minlength=b - a)
        at = np.concatenate([[0], np.cumsum(words + 1)])
        out = np.empty(at[-1], np.uint64)
        out[np.arange(len(row)) + row] = span_hashes(part, starts, ends, fold=True)
        out[at[1:] - 1] = END
        yield a, b, out, at


def word_counts(docs: DataFrame) -> DataFrame:
    """h, c (in training tokens) and a (in all) for each distinct token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of hash, training count, count
        size = 0

        def fold() -> np.ndarray:
            every = np.concatenate(held, axis=1)
            order = np.argsort(every[0], kind="stable")
            every = every[:, order]
            first = np.flatnonzero(np.concatenate([[True], every[0, 1:] != every[0, :-1]]))
            return np.stack([every[0, first], *(np.add.reduceat(every[k], first) for k in (1, 2))])

        def out(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(r.view(np.int64)) for r in np.ascontiguousarray(x)], names=["h", "c", "a"])

        for batch in batches:
            trained = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, tokens, at in tokens_of(batch.column(0)):
                uses = np.repeat(trained[a:b], np.diff(at))
                h, where = np.unique(tokens, return_inverse=True)
                counts = np.bincount(where, minlength=len(h))
                held.append(np.stack([h, np.bincount(where[uses], minlength=len(h)).astype(np.uint64), counts.astype(np.uint64)]))
                size += len(h)
                if size > 1_500_000:
                    held = [fold()]
                    if (size := held[0].shape[1]) > 750_000:
                        yield out(held[0])
                        held, size = [], 0
        if held:
            yield out(fold())

    part = docs.mapInArrow(run, "h long, c long, a long")
    return part.groupBy("h").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def _table(df: DataFrame) -> np.ndarray:
    """Rows of two long columns, by the first as unsigned."""
    got = df.toArrow()
    h, c = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(h)
    return np.stack([h[order], c[order].view(np.uint64)])


def _look_up(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted ``table``, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Model:
    """Parameters; ``flat`` and ``load`` for sending and averaging."""

    def __init__(self, unigram: np.ndarray, s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        k, d = len(unigram), s.width
        self.log_p = np.log(unigram).astype(np.float32)
        self.r = rng.normal(0, 0.1, (k + 1, d)).astype(np.float32)  # the last row stands before a text
        self.c = (np.stack([np.eye(d), np.eye(d)]) * 0.7 + rng.normal(0, 0.05, (2, d, d))).astype(np.float32)
        self.q = rng.normal(0, 0.1, (k, d)).astype(np.float32)
        self.b = self.log_p.copy()

    def arrays(self) -> list[np.ndarray]:
        return [self.r, self.c, self.q, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def load(self, flat: np.ndarray) -> "Model":
        at = 0
        for x in self.arrays():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return self

    def squares(self) -> list[np.ndarray]:
        """Sums of squared gradients, to begin with."""
        return [np.full(x.shape, 0.1, np.float32) for x in self.arrays()]

    def train(self, contexts: np.ndarray, targets: np.ndarray, s: Settings, rate: float, rng: np.random.Generator, seen: list[np.ndarray]) -> None:
        """One pass of noise-contrastive estimation; all tokens of a batch share its noise samples."""
        cut = np.cumsum(np.exp(self.log_p, dtype=np.float64))
        shift = self.log_p + np.float32(math.log(s.noise))

        def step(x: np.ndarray, g2: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
            g2[rows] += grad * grad
            x[rows] -= rate * grad / np.sqrt(g2[rows])

        def gathered(grad: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(ids, kind="stable")
            own = ids[order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            return own[first], np.add.reduceat(grad[order], first, axis=0)

        order = rng.permutation(len(targets))
        for at in range(0, len(order), s.batch):
            pick = order[at : at + s.batch]
            w2, w1 = contexts[pick, 0], contexts[pick, 1]
            w, noise = targets[pick], np.minimum(np.searchsorted(cut, rng.random(s.noise) * cut[-1]), len(cut) - 1)
            r2, r1 = self.r[w2], self.r[w1]
            x = r2 @ self.c[0] + r1 @ self.c[1]
            qw, qn = self.q[w], self.q[noise]
            scale = np.float32(1 / len(pick))
            e_w = -scale / (1 + np.exp(np.clip(np.einsum("bd,bd->b", x, qw) + self.b[w] - shift[w], -30, 30)))
            e_n = scale / (1 + np.exp(-np.clip(x @ qn.T + self.b[noise] - shift[noise], -30, 30)))
            dx = e_w[:, None] * qw + e_n @ qn
            ids, gq = gathered(np.concatenate([e_w[:, None] * x, e_n.T @ x]), np.concatenate([w, noise]))
            _, gb = gathered(np.concatenate([e_w, e_n.sum(0)])[:, None], np.concatenate([w, noise]))
            rows, gr = gathered(np.concatenate([dx @ self.c[0].T, dx @ self.c[1].T]), np.concatenate([w2, w1]))
            gc = np.stack([r2.T @ dx, r1.T @ dx])
            for (p, g2), (grad, where) in zip(zip(self.arrays(), seen, strict=True), ((gr, rows), (gc, slice(None)), (gq, ids), (gb[:, 0], ids)), strict=True):
                step(p, g2, grad, where)

    def context_tables(self) -> tuple[np.ndarray, np.ndarray]:
        return self.r @ self.c[0], self.r @ self.c[1]


def _contexts(ids: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """The two ids before each token, ``start`` before a text; ends: where each text's tokens end."""
    out = np.full((len(ids), 2), start, ids.dtype)
    out[1:, 1] = ids[:-1]
    out[2:, 0] = ids[:-2]
    first = np.concatenate([[0], ends[:-1]])
    out[first] = start
    second = first + 1
    out[second[second < ends], 0] = start
    return out


def _encoded(docs: DataFrame, vocab, heavy) -> DataFrame:
    """Each document's class ids, what its frequent words add to the sums, and its other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (hashes, counts) = vocab.value, heavy.value
        order = np.argsort(words)
        words, rank = words[order], (order + 1).astype(np.uint16)
        logs = np.log10(counts.astype(np.int64) + 1.0)
        n = TaskContext.get().partitionId() << 33
        for batch in batches:
            doc, held = batch.column(0), batch.column(2)
            for a, b, tokens, at in tokens_of(batch.column(1)):
                row = np.repeat(np.arange(b - a), np.diff(at))
                k = _look_up(words, tokens)
                ids = np.where(k >= 0, rank[k] if len(rank) else 0, 0).astype("<u2")
                j = _look_up(hashes, tokens)
                known = np.where(j >= 0, logs[j] if len(logs) else 0.0, 0.0)
                add = lambda mask, x: np.bincount(row[mask], x[mask] if x is not None else None, minlength=b - a)
                rest = np.flatnonzero(j < 0)
                # distinct other words of each row
                by = np.lexsort([tokens[rest], row[rest]])
                own, r = tokens[rest][by], row[rest][by]
                first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (r[1:] != r[:-1])])) if len(own) else np.empty(0, int)
                times = np.diff(np.concatenate([first, [len(own)]]))
                lists = np.concatenate([[0], np.cumsum(np.bincount(r[first], minlength=b - a))]).astype(np.int32)
                raw, cuts = ids.tobytes(), at * 2
                hit = j >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n, n + b - a)), doc.slice(a, b - a), held.slice(a, b - a), pa.array([raw[cuts[i] : cuts[i + 1]] for i in range(b - a)], pa.binary()),
                     pa.array(np.diff(at)), pa.array(add(hit & (np.where(hit, counts[j] if len(counts) else 0, 0) > 0), None)), pa.array(add(hit, known).astype(float)),
                     pa.array(add(hit & (ids == 0), known).astype(float)), pa.array(add(ids == 0, None)),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(own[first].view(np.int64))), pa.ListArray.from_arrays(pa.array(lists), pa.array(times.astype(np.int32)))],
                    names=names,
                )
                n += b - a

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["uid", "doc_id", "held_out", "ids", "n_tokens", "known", "log_sum", "other_log_sum", "n_other", "rest", "times"]
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, ids binary, n_tokens long, known long, log_sum double, other_log_sum double, n_other long, rest array<long>, times array<int>")


def fit(encoded: DataFrame, unigram: np.ndarray, s: Settings) -> Model:
    """Rounds of training in every shard, each followed by an average weighted by tokens."""
    spark, model = encoded.sparkSession, Model(unigram, s)
    flat = model.flat()
    drawn = encoded.where(~F.col("held_out")).select("ids", F.xxhash64("ids", "doc_id").alias("key"))
    # whole documents of a part; a shard's place in the average is its number
    tokens = {r.turn: r.n for r in drawn.groupBy(F.pmod(F.xxhash64("key", F.lit(s.seed)), F.lit(s.rounds)).alias("turn")).agg(F.sum(F.octet_length("ids") / 2).alias("n")).collect()}
    for turn in range(s.rounds):
        shards = max(1, -(-int(tokens.get(turn, 0)) // s.shard_tokens))
        sent = spark.sparkContext.broadcast(flat)
        rate = s.rate / (1 + turn)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate, turn=turn) -> Iterator[pa.RecordBatch]:
            shard = TaskContext.get().partitionId()
            own, rng = Model(unigram, s).load(sent.value), np.random.default_rng([s.seed, turn, shard])
            squares, total, held, size = own.squares(), 0, [], 0

            def read() -> None:
                sizes = np.array([len(x) for x in held]) // 2
                ids = np.frombuffer(b"".join(held), "<u2").astype(np.int32)
                own.train(_contexts(ids, np.cumsum(sizes), len(unigram)), ids, s, rate, rng, squares)

            for batch in batches:
                for x in batch.column(0).to_pylist():
                    held.append(x)
                    size += len(x) // 2
                    if size >= READ_TOKENS:
                        read()
                        total, held, size = total + size, [], 0
            if size:
                read()
                total += size
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([total]), pa.array([(own.flat().astype(np.float64) * total).tobytes()])], names=["shard", "n", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # in the order of the children, so that sums don't depend on which arrives first
            rows = sorted(x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if rows:
                sums = np.frombuffer(rows[0][3]).copy()
                for *_, x in rows[1:]:
                    sums += np.frombuffer(x)
                yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([sum(r[2] for r in rows)]), pa.array([sums.tobytes()])], names=["shard", "n", "sums"])

        part = drawn.where(F.pmod(F.xxhash64("key", F.lit(s.seed)), F.lit(s.rounds)) == turn)
        dealt = part.repartitionById(shards, F.pmod(F.xxhash64("key", F.lit(s.seed + 1)), F.lit(shards)).cast("int")).sortWithinPartitions("key", "ids")
        summed, left = dealt.select("ids").mapInArrow(run, "shard long, n long, sums binary"), shards
        # a tree of fixed fan-in: no task adds more than FAN sums, and one reaches the driver whatever the corpus
        while left > 1:
            left = -(-left // FAN)
            above = F.floor(F.col("shard") / FAN).cast("long")
            summed = summed.select(above.alias("shard"), F.col("shard").alias("child"), "n", "sums").repartitionById(left, F.col("shard").cast("int")).mapInArrow(add, "shard long, n long, sums binary")
        summed = summed.collect()
        if summed:
            flat = (np.frombuffer(summed[0].sums) / summed[0].n).astype(np.float32)
        sent.unpersist()
    return model.load(flat)


def normalisers(spark, model: Model) -> np.ndarray:
    """log of the sum of exponentials for every pair of context words, by batched matrix products on the executors."""
    left, right = model.context_tables()
    sent = spark.sparkContext.broadcast((left, right, model.q, model.b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, q, b = sent.value
        base = right @ q.T + b
        for batch in batches:
            rows = batch.column(0).to_pylist()
            out = []
            for i in rows:
                logits = base + left[i] @ q.T
                top = logits.max(1)
                out.append((np.log(np.exp(logits - top[:, None]).sum(1)) + top).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(out, pa.binary())], names=["i", "z"])

    got = spark.range(0, len(left), 1, min(24, len(left))).mapInArrow(run, "i long, z binary").collect()
    return np.stack([np.frombuffer(r.z, np.float32) for r in sorted(got, key=lambda r: r.i)])


def score(docs: DataFrame, held_out, settings: Settings = Settings()) -> DataFrame:
    """Per document: token counts, the add-one base score and the model's score; ``held_out`` says which rows don't train."""
    spark, s = docs.sparkSession, settings
    tune(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = materialize(word_counts(rows.select("text", "held_out")), "lm-counts")
    sums = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum("a")).first()
    n, v, every = (int(x or 0) for x in sums)
    end = int(END)
    classes = min(s.most, max(s.least, 1 << max(0, math.isqrt(max(v, 1)) - 1).bit_length()))
    top = counts.where(f"c > 0 AND h != {end}").orderBy(F.desc("c"), "h").limit(classes - 2).select("h", "c")
    words = top.toArrow()
    hashes = np.concatenate([[END], words.column(0).to_numpy().view(np.uint64)])
    ends = counts.where(f"h = {end}").select("c").collect()
    c_words = np.concatenate([[ends[0].c if ends else 0], words.column(1).to_numpy()]).astype(float)
    other = float(n + v + 1 - (c_words + 1).sum() + (1 if not c_words[0] else 0))  # the mass of other words; an end without counts isn't among them
    unigram = np.concatenate([[max(other, 1.0)], c_words + 1])
    unigram /= unigram.sum()
    heavy = _table(counts.where((F.col("a") * HEAVY >= every) | F.col("h").isin(hashes.view(np.int64).tolist())).select("h", "c"))
    sent, common = spark.sparkContext.broadcast(hashes), spark.sparkContext.broadcast(heavy)
    encoded = materialize(_encoded(rows, sent, common), "lm-encoded")
    model = fit(encoded, unigram, s)
    tables = spark.sparkContext.broadcast((*model.context_tables(), model.q, model.b, normalisers(spark, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, q, b, z = tables.value
        for batch in batches:
            out = []
            for raw in batch.column(0).to_pylist():
                ids, total = np.frombuffer(raw, "<u2").astype(np.int32), 0.0
                contexts = _contexts(ids, np.array([len(ids)]), len(q))
                for at in range(0, len(ids), 1 << 16):
                    w, (w2, w1) = ids[at : at + (1 << 16)], contexts[at : at + (1 << 16)].T
                    total += float((np.einsum("bd,bd->b", left[w2] + right[w1], q[w]) + b[w] - z[w2, w1]).sum(dtype=np.float64))
                out.append(total / math.log(10))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.float64())], names=names)

    kept = ["uid", "doc_id", "held_out", "n_tokens", "known", "log_sum", "other_log_sum", "n_other"]
    names = [*kept, "model"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = encoded.select("ids", *kept).mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, known long, log_sum double, other_log_sum double, n_other long, model double")
    rest = encoded.select("uid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("uid", F.col("x.rest").alias("h"), F.col("x.times").alias("times"))
    joined = rest.join(counts.where((F.col("a") * HEAVY < every) & (F.col("c") > 0)).select("h", "c"), "h")
    more = joined.groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    added, known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    return scored.join(more, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_sum") + added - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("model") + F.col("other_log_sum") + added - F.col("n_other") * F.lit(math.log10(max(other, 1.0)))).alias("score"),
    )
