"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how common each pair of ids is.

Both tokenizers write the same bytes, so each byte of a text gets a label: no token ends here, one of A does, one of B
does, or both do. A regular expression scans the label string for spans up to each byte where both end; a span's labels
give the numbers of tokens of its group. All pairs of an A and a B token of a group are links, counted, not listed.

How common a pair of ids is needs a second look at every text. So tasks work in blocks of ``BLOCK`` bytes: a block numbers
its kinds of groups (the ids on both sides), a text is the kinds that it has and how often, and the block gives one row for
each kind and pair of ids and, for each pair, how many of its texts hold it. Sums over blocks are the corpus counts; they
are joined back to the blocks' kinds, whose totals are all that a text needs. So nothing as long as the texts is ever
joined, a common pair has a row for each block and not for each text, and tokens are made once.

Defined results: a null or empty text, and one that either tokenizer does not give back byte for byte (B reads U+2581 as a
space), has no tokens, zero counts and an empty digest; strings of special tokens are plain text; copies and repeated rows
each count as a document; ties for an A id's highest count all count; a text beyond ``LONG`` characters is cut for B where
no merge can cross, which gives the same ids; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_buffers, tune
from .packing import _byte_of, encoder
from .pieces import SPACE, Pieces

#: Bytes of text of a block, and characters from which a text is cut for B.
BLOCK, LONG = 8 << 20, 1 << 18
#: Labels of a byte by the ends at it: neither, A, B, both.
LABELS = np.frombuffer(b".AB|", np.uint8)
SPAN = re.compile(rb"[^|]*\|")
#: Bits of an id in the key of a small group.
ID_BITS = 21
_tools: dict[tuple[str, str], "Tokenizers"] = {}


class Tokenizers:
    """Ids of A and B with the bytes of each of their tokens. A is byte-level BPE and reads a space and the text; B adds the space."""

    def __init__(self, a: str, b: str) -> None:
        self.encoder = encoder(a)
        as_byte = _byte_of()
        with open(a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            # the piece of a special token may hold other characters, and never comes out
            self.a_bytes[i] = bytes(as_byte.get(c, 0) for c in piece)
        with open(b, "rb") as f:
            self.b = Pieces(f.read())
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.tool.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.b.names)]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.slow = None

    def a_ids(self, text: str) -> np.ndarray:
        if self.encoder.fast is not None:
            return self.encoder.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.encoder.path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def b_ids(self, text: str) -> list[int]:
        return [i for part in self.b.chunks(text, LONG) for i in self.b.tool.encode(part)]

    def both(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a text, or None where either side's bytes are not the text's."""
        if not text:
            return None
        spaced = " " + text
        raw, b = spaced.encode(), self.b_ids(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        a = self.a_ids(spaced)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw:
            return None
        return a, np.array(b, np.int64)


def tokenizers_of(a: str, b: str) -> Tokenizers:
    if (a, b) not in _tools:
        _tools[a, b] = Tokenizers(a, b)
    return _tools[a, b]


class _Counts(dict):
    """Numbers of A and B tokens of a span of labels, A's in the upper half; short spans are remembered."""

    def __missing__(self, span: bytes) -> int:
        out = (span.count(b"A") + 1 << 32) + span.count(b"B") + 1
        if len(span) <= 48:
            self[span] = out
        return out


_counts = _Counts()


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of A and B tokens of each group, from the bytes after each token; both sides end at the same byte."""
    labels = np.zeros(int(a_ends[-1]) if len(a_ends) else 0, np.uint8)
    labels[a_ends - 1] |= 1
    labels[b_ends - 1] |= 2
    found = np.fromiter(map(_counts.__getitem__, SPAN.findall(LABELS[labels].tobytes())), np.int64)
    return found >> 32, found & 0xFFFFFFFF


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of ``size`` entries."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Block:
    """Texts of about ``BLOCK`` bytes, with their kinds of groups numbered as they come."""

    def __init__(self, tools: Tokenizers) -> None:
        self.tools, self.kinds, self.sides, self.names = tools, {}, [], []
        self.docs, self.bytes, self.rows = [], 0, 0

    def kind(self, key: object, a: np.ndarray, b: np.ndarray) -> int:
        out = self.kinds.setdefault(key, len(self.sides))
        if out == len(self.sides):
            self.sides.append((a, b))
            self.names.append(",".join(map(str, a.tolist())) + "|" + ",".join(map(str, b.tolist())))
        return out

    def add(self, ids: pa.Array, texts: list[str | None]) -> None:
        """Texts that are labelled and scanned as one string: each ends with a byte where both tokenizers end."""
        found = [self.tools.both(t) for t in texts]
        a, b = (np.concatenate([x[side] for x in found if x] or [np.empty(0, np.int64)]) for side in (0, 1))
        n_a, n_b = (np.array([len(x[side]) if x else 0 for x in found], np.int64) for side in (0, 1))
        ends = np.cumsum(self.tools.a_size[a])
        in_a, in_b = groups_of(ends, np.cumsum(self.tools.b_size[b]))
        at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        kinds = np.empty(len(in_a), np.int64)
        left = np.ones(len(in_a), bool)
        for p, q in ((1, 1), (1, 2), (2, 1)):
            own = np.flatnonzero((in_a == p) & (in_b == q))
            left[own] = False
            key = np.zeros(len(own), np.int64)
            for column in [a[at_a[own] + k] for k in range(p)] + [b[at_b[own] + k] for k in range(q)]:
                key = key << ID_BITS | column
            _, first, place = np.unique(key, return_index=True, return_inverse=True)
            number = [self.kind((p, q, int(key[f])), a[at_a[g] : at_a[g] + p], b[at_b[g] : at_b[g] + q]) for f, g in zip(first, own[first], strict=True)]
            kinds[own] = np.array(number, np.int64)[place]
        for g in np.flatnonzero(left).tolist():
            x, y = a[at_a[g] : at_a[g] + in_a[g]], b[at_b[g] : at_b[g] + in_b[g]]
            kinds[g] = self.kind((len(x), x.tobytes(), y.tobytes()), x, y)
        # a text's groups end where its A tokens do
        cut = np.searchsorted(at_a, np.cumsum(n_a))
        n_groups = np.diff(np.concatenate([[0], cut]))
        owner = np.repeat(np.arange(len(texts)), n_groups)
        n_links = np.bincount(owner, in_a * in_b, len(texts)).astype(np.int64)
        key, times = np.unique(owner << 32 | kinds, return_counts=True)
        has = np.concatenate([[0], np.cumsum(np.bincount(key >> 32, minlength=len(texts)))])
        names, listed, digests = self.names, kinds.tolist(), []
        for start, end in zip(cut - n_groups, cut, strict=True):
            digests.append(hashlib.sha256(";".join(map(names.__getitem__, listed[start:end])).encode()).hexdigest() if end > start else "")
        self.docs.append((ids, n_a, n_b, n_groups, n_links, digests, key & 0xFFFFFFFF, times, has))
        self.rows += len(texts)

    def held(self) -> Iterator[tuple[str, list]]:
        """Rows of three sorts: texts with their kinds, kinds with their links, pairs with the number of texts that hold them."""
        for ids, n_a, n_b, n_groups, n_links, digests, kinds, times, has in self.docs:
            lists = [[x[s:e].astype("<u4").tobytes() for s, e in zip(has, has[1:], strict=False)] for x in (kinds, times)]
            yield "texts", [ids, *(pa.array(x) for x in (n_a, n_b, n_groups, n_links)), pa.array(digests, pa.string()), *(pa.array(x, pa.binary()) for x in lists)]
        # links of a kind: its distinct ids meet, as often as both occur
        one = [(*np.unique(x, return_counts=True), *np.unique(y, return_counts=True)) for x, y in self.sides]
        size = np.array([len(x) * len(y) for x, _, y, _ in one], np.int64)
        a = np.concatenate([np.repeat(x, len(y)) for x, _, y, _ in one] or [np.empty(0, np.int64)])
        b = np.concatenate([np.tile(y, len(x)) for x, _, y, _ in one] or [np.empty(0, np.int64)])
        times = np.concatenate([np.repeat(m, len(y)) * np.tile(n, len(x)) for x, m, y, n in one] or [np.empty(0, np.int64)])
        yield "kinds", [pa.array(np.repeat(np.arange(len(size)), size)), pa.array(a), pa.array(b), pa.array(times)]
        pairs, place = np.unique(a << 32 | b, return_inverse=True)
        first, total = np.cumsum(size) - size, np.zeros(len(pairs), np.int64)
        for *_, kinds, _, has in self.docs:
            owner = np.repeat(np.arange(len(has) - 1), np.diff(has))
            every = place[_ranges(first[kinds], size[kinds])]
            total += np.bincount(np.unique(np.repeat(owner, size[kinds]) * max(len(pairs), 1) + every) % max(len(pairs), 1), minlength=len(pairs))
        yield "pairs", [pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(total)]


_FIELDS = [("sort", pa.string()), ("block", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("kinds", pa.binary()), ("often", pa.binary()), ("kind", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("times", pa.int64())]
_OF_SORT = {"texts": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "kinds", "often"], "kinds": ["kind", "a", "b", "times"], "pairs": ["a", "b", "times"]}


def blocks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """The rows of each block: see ``Block.held``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, number, block = tokenizers_of(a, b), TaskContext.get().partitionId() << 32, None
        like = None

        def out() -> Iterator[pa.RecordBatch]:
            for sort, columns in block.held():
                n = len(columns[0])
                named = dict(zip(_OF_SORT[sort], columns, strict=True)) | {"sort": pa.array([sort] * n, pa.string()), "block": pa.array([number] * n, pa.int64())}
                yield pa.RecordBatch.from_arrays([named.get("doc_id", pa.nulls(n, like)), *(named.get(f, pa.nulls(n, t)) for f, t in _FIELDS)], names=["doc_id", *(f for f, _ in _FIELDS)])

        for batch in batches:
            like = batch.column(0).type
            _, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                block = block or Block(tools)
                block.add(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).to_pylist())
                block.bytes += int(offsets[hi] - offsets[lo])
                if block.bytes >= BLOCK or block.rows >= 1 << 16:
                    yield from out()
                    number, block = number + 1, None
        if block:
            yield from out()

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ", ".join(f"{f} {'string' if t == pa.string() else 'binary' if t == pa.binary() else 'long'}" for f, t in _FIELDS)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {names}")


def _totals(texts, kinds):
    """Sums of counts and of best links of a block's texts from those of its kinds."""
    import pandas as pd

    most = int(kinds.kind.max()) + 1 if len(kinds) else 0
    count, best = np.zeros(most, np.int64), np.zeros(most, np.int64)
    count[kinds.kind.to_numpy()], best[kinds.kind.to_numpy()] = kinds["count"].to_numpy(), kinds.best.to_numpy()
    has = np.array([len(k) // 4 for k in texts.kinds], np.int64)
    kind, often = (np.frombuffer(b"".join(texts[c]), "<u4").astype(np.int64) for c in ("kinds", "often"))
    end = np.concatenate([[0], np.cumsum(has)])
    sums = [np.concatenate([[0], np.cumsum(x[kind] * often)]) for x in (best, count)]
    out = texts[["doc_id", "n_a", "n_b", "n_groups", "n_links"]].copy()
    out["n_best"], out["count_sum"] = (x[end[1:]] - x[end[:-1]] for x in sums)
    return pd.concat([out, texts["groups_sha256"]], axis=1)


def pair_counts(held: DataFrame) -> DataFrame:
    """a, b, the number of documents that hold them linked, and whether no B id has more with that A id."""
    counts = held.where("sort = 'pairs'").groupBy("a", "b").agg(F.sum("times").alias("count"))
    counts = materialize(counts, "alignment-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    tune(docs.sparkSession)
    held = materialize(blocks(docs, a, b), "alignment-blocks")
    links = held.where("sort = 'kinds'").select(F.col("block").alias("of"), "kind", "a", "b", "times")
    weighed = links.join(pair_counts(held), ["a", "b"])
    kinds = weighed.groupBy("of", "kind").agg(F.sum(F.col("times") * F.col("count")).alias("count"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"))
    texts = held.where("sort = 'texts'").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "kinds", "often")
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = texts.groupBy("block").cogroup(kinds.groupBy("of"))
    return both.applyInPandas(_totals, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
