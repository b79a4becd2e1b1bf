"""Best-fit packing by a plan over the histogram of lengths.

Documents become token ids plus one end token; only documents longer than a sequence are cut, the first piece taking the
remainder. Piece lengths are at most ``size``, so the histogram has at most ``size`` entries whatever the corpus: the
driver plans best-fit decreasing on the counts, bins of equal fill moving together, and gets a table of slots by rank
within a length. Each piece then finds its place from its rank: tasks number their own pieces of each length while
they tokenise, a join on (task, length) adds the pieces of earlier tasks, and the plan maps the rank to a sequence.

Defined results: a null or empty text is one end token; copies and repeated rows are packed separately; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tune

# Fixed value: the pattern by which the ``ByteLevel`` pre-tokenizer cuts text; files name it by ``use_regex`` only.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[str, "Encoder"] = {}


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order, as code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of a ``tokenizers`` file, as that library gives them with ``add_special_tokens=False``: the strings of the file's
    added tokens are those tokens in a text too.

    A plain byte-level BPE, whose ids are in merge order, is run by ``tiktoken``, which gives the same ids without building
    offsets; other files, texts with added tokens and what ``tiktoken`` refuses go to ``tokenizers``."""

    def __init__(self, path: str) -> None:
        self.path, self.slow, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.added = [t["content"] for t in model.get("added_tokens", [])]
        cut, bpe = model.get("pre_tokenizer") or {}, model["model"]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not model.get("normalizer") and not model.get("truncation")
        if plain and bpe["type"] == "BPE" and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            import tiktoken

            special, as_byte = {t["id"] for t in model.get("added_tokens", [])}, _byte_of()
            ranks = {bytes(as_byte[c] for c in piece): i for piece, i in bpe["vocab"].items() if i not in special}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def reference(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added):
            return self.reference(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except Exception:  # the regex engine gives up on some endless runs
            return self.reference(text)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, path: str, size: int, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the task and number within (task, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            out = [[] for _ in range(6)]
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    for column, value in zip(out, (i, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), seen[length]), strict=True):
                        column.append(value)
                    seen[length] += 1
            took, *rest = (pa.array(x, pa.int64()) for x in out)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), rest[0].cast(pa.int32()), *rest[1:4], pa.array([task] * len(took), pa.int64()), rest[4]], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, number long")


def plan(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: (length, first rank, bins, items in each bin, first bin, offset in them), and the bins.

    Bins of equal fill are ranges of bin numbers, so the work depends on ``size`` and not on the counts."""
    slots, n_bins = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # space left -> ranges of bins
    spaces: list[int] = []  # sorted keys of room

    def put(space: int, first: int, bins: int) -> None:
        if space and bins:
            if space not in room:
                room[space] = []
                bisect.insort(spaces, space)
            room[space].append((first, bins))

    for length in sorted((k for k in counts if counts[k]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, bins = room[space].pop()
                if not room[space]:
                    del room[space], spaces[at]
            else:
                space, first, bins = size, n_bins, -(-left // (size // length))
                n_bins += bins
            each = space // length
            full = min(bins, left // each)
            if full:
                slots.append((length, rank, full, each, first, size - space))
                rank, left = rank + full * each, left - full * each
                put(space - each * length, first, full)
            if full < bins and left:
                slots.append((length, rank, 1, left, first + full, size - space))
                put(space - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(space, first + full, bins - full)
    return slots, n_bins


def pack(docs: DataFrame, path: str, size: int = 2048, end: int = 0) -> DataFrame:
    """One row for each piece, with its sequence and offset."""
    spark = docs.sparkSession
    tune(spark)
    held = materialize(pieces(docs, path, size, end), "pieces")
    by_task = materialize(held.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    slots, _ = plan(counts, size)
    table = np.array(sorted(slots), np.int64).reshape(-1, 6)
    heads = np.searchsorted(table[:, 0], np.arange(size + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            row = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                row[own] = heads[n] + np.searchsorted(table[heads[n] : heads[n + 1], 1], rank[own], "right") - 1
            _, first, _, each, bin_, offset = table[row].T
            k = rank - first
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bin_ + k // each), pa.array(offset + k % each * length)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    at = held.join(base.hint("merge"), ["task", "length"]).select(*names, (F.col("before") + F.col("number")).alias("rank"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return at.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
