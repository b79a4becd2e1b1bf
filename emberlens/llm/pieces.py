"""SentencePiece encoding and decoding, with giant documents cut into chunks that different tasks encode.

For unigram models a giant document is scanned in parallel. The state at a chunk's edge is how many characters the last
piece reaches past it. Each chunk gives a max-plus matrix, the best score from each entry state to each exit state;
matrices combine associatively; then every chunk is traced back on its own between the states that the best path has.
``transfer``, ``combine``, ``edges`` and ``trace`` are these steps. Cuts are put before a space that follows another
character where one is near and no piece holds a space after another character: no piece crosses such a cut, so its only
state is 0, the matrix between two such cuts is a single score, and the best path inside is the library's own.

BPE models have no sum of scores to maximise: their segmentation is the outcome of greedy merges, which a max-plus scan
can't give. Their chunks are cut where no merge can cross, and the library encodes such chunks exactly as it does the
whole. ``kind=UNIGRAM`` reads a BPE file's pieces and scores as a unigram model instead.

Defined results: a null or empty text has no ids and decodes to an empty text; copies and repeated rows are encoded
separately; an empty table gives an empty result; a text of one endless word stays one chunk for a BPE model; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NEVER = -1e30


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            value: object = number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            value = raw[at : at + size]
            at += size
        yield key >> 3, value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_as(raw: bytes, kind: int) -> bytes:
    """The model with another type, which is field 3 of the trainer's message, field 2; the last value of a field counts."""
    return raw + b"\x12\x02\x18" + _varint(kind)


class Pieces:
    """A model file: the library's processor and what the parallel paths need to know of it."""

    def __init__(self, raw: bytes) -> None:
        import sentencepiece

        self.tool = sentencepiece.SentencePieceProcessor(model_proto=raw)
        trainer = b"".join(v for k, v in _fields(raw) if k == 2)
        self.kind = dict(_fields(trainer)).get(3, UNIGRAM)
        normal = next((dict(_fields(v)) for k, v in _fields(raw) if k == 3), {})
        # what cutting relies on: characters stay themselves, spaces stay, a leading space is added
        self.plain = normal.get(1) in (b"identity", None, b"") and not normal.get(2) and normal.get(3, 1) == 1 and normal.get(4, 1) == 0
        n = self.tool.get_piece_size()
        self.names = [self.tool.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (self.tool.is_control(i) or self.tool.is_unknown(i) or self.tool.is_byte(i) or self.tool.is_unused(i))]
        self.ids = {self.names[i]: i for i in usable}
        self.longest = max(map(len, self.ids), default=1)
        self.cuts = self.plain and not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        scores = {i: self.tool.get_score(i) for i in usable}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.unknown = min(scores.values(), default=0.0) - 10.0  # the library's penalty for a character without a piece

    def chunks(self, text: str, size: int) -> list[str]:
        """Parts whose encodings, one after the other, are the text's; for BPE models."""
        if len(text) <= size or not self.cuts:
            return [text]
        out, at = [], 0
        while len(text) - at > size:
            cut = at + size
            while cut < len(text) and not (text[cut] == " " and text[cut - 1] not in (" ", SPACE)):
                cut += 1
            if cut >= len(text) - 1:
                break
            out.append(text[at:cut])
            at = cut + 1  # the next part's added space stands for this one
        return [*out, text[at:]]

    def cut(self, text: str, size: int, near: int = 256) -> list[tuple[str, int, bool, bool]]:
        """Chunks for the scan: the text with what pieces may reach past its end, its own characters, and whether pieces cross its start and its end."""
        out, at, crossed = [], 0, False
        while len(text) - at > size + near:
            cut = next((i for i in range(at + size, at + size + near) if text[i] == " " and text[i - 1] not in (" ", SPACE)), -1) if self.cuts else -1
            if cut < 0:
                out.append((text[at : at + size + self.longest], size, crossed, True))
                at, crossed = at + size, True
            else:
                out.append((text[at:cut], cut - at, crossed, False))
                at, crossed = cut, False
        return [*out, (text[at:], len(text) - at, crossed, False)]

    # The max-plus scan. Text is normalised: spaces are U+2581.

    def steps(self, text: str, i: int) -> Iterator[tuple[int, float]]:
        """Ends and scores of the pieces that start at i; a character without one is unknown."""
        single = False
        for j in range(i + 1, min(len(text), i + self.longest) + 1):
            if (s := self.score.get(text[i:j])) is not None:
                single |= j == i + 1
                yield j, s
        if not single:
            yield i + 1, self.unknown

    def transfer(self, text: str, a: int, b: int) -> np.ndarray:
        """Best scores between entry states at a and exit states at b, by pieces that start in [a, b)."""
        states = self.longest
        v = np.full((b - a + states, states), NEVER)
        v[np.arange(min(states, b - a + states)), np.arange(states)] = 0.0
        for i in range(a, b):
            here = v[i - a]
            for j, s in self.steps(text, i):
                np.maximum(v[j - a], here + s, out=v[j - a])
        out = v[b - a :].T.copy()
        # an entry beyond the chunk passes through; entries inside start at 0 where they stand
        return out

    @staticmethod
    def combine(m: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The max-plus product; associative."""
        return (m[:, :, None] + n[None]).max(1)

    def edges(self, matrices: list[np.ndarray]) -> list[int]:
        """The best path's state at each edge, from prefix scores; both outer edges are state 0."""
        best = [np.where(np.arange(self.longest) == 0, 0.0, NEVER)]
        for m in matrices:
            best.append((best[-1][:, None] + m).max(0))
        states = [0]
        for m, before in zip(reversed(matrices), reversed(best[:-1]), strict=True):
            states.append(int(np.argmax(before + m[:, states[-1]])))
        return states[::-1]

    def trace(self, text: str, a: int, b: int, entry: int, leave: int) -> list[int]:
        """Ids of the best path from a + entry to b + leave."""
        n = b - a + self.longest
        best, back = [NEVER] * n, [-1] * n
        best[entry] = 0.0
        for i in range(a + entry, b):
            if best[i - a] <= NEVER / 2:
                continue
            for j, s in self.steps(text, i):
                if best[i - a] + s > best[j - a]:
                    best[j - a], back[j - a] = best[i - a] + s, i - a
        out, at = [], b - a + leave
        while at > entry:
            out.append(text[a + back[at] : a + at])
            at = back[at]
        return [i for piece in reversed(out) for i in self._ids(piece)]

    def _ids(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        as_bytes = [self.tool.piece_to_id(f"<0x{b:02X}>") for b in piece.encode()]
        return as_bytes if all(self.tool.is_byte(i) for i in as_bytes) else [self.tool.unk_id()]


_models: dict[int, Pieces] = {}


def model_of(raw: bytes) -> Pieces:
    key = zlib.crc32(raw)
    if key not in _models:
        _models[key] = Pieces(raw)
    return _models[key]


SLICE_CHARS = 1 << 18


def _few(texts: list[str]) -> Iterator[list[str]]:
    """Texts in groups of bounded size: the library returns ids as Python lists."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, chunk_chars: int = 1 << 15, kind: int | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_chunks and text_crc32 of each row.

    Texts of up to ``chunk_chars`` are encoded where they are; longer ones are cut and their chunks dealt to all tasks."""
    spark = docs.sparkSession
    tune(spark)
    with open(path, "rb") as f:
        raw = f.read()
    raw = raw if kind is None else read_as(raw, kind)
    model = model_of(raw)
    sent = spark.sparkContext.broadcast(raw)
    scan = model.kind == UNIGRAM and model.plain
    doc = docs.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(sent.value)
        for batch in batches:
            at = 0
            for texts in _few(batch.column(1).to_pylist()):
                ids = [np.array(x, "<u4").tobytes() for x in own.tool.encode(texts, num_threads=1)]
                crc = [zlib.crc32(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(ids, pa.binary()), pa.array([1] * len(texts), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "ids", "n_chunks", "text_crc32"])
                at += len(texts)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, uid = model_of(sent.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                parts = own.cut(text, chunk_chars) if scan else [(t, len(t), False, False) for t in own.chunks(text, chunk_chars)]
                n = len(parts)
                chars, size, entry, leave = zip(*parts, strict=True)
                # the space at an open cut is the one that the library puts before a text
                chars = [t[1:] if scan and k and not a and not b else t for k, (t, a, b) in enumerate(zip(chars, entry, leave, strict=True))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid] * n, pa.int64()), batch.column(0).take(pa.array([i] * n)), pa.array(range(n), pa.int64()), pa.array([zlib.crc32(text.encode())] * n, pa.int64()),
                     pa.array(chars, pa.string()), pa.array(size, pa.int32()), pa.array([a or b for a, b in zip(entry, leave, strict=True)])],
                    names=["uid", "doc_id", "chunk", "text_crc32", "part", "size", "crossed"],
                )
                uid += 1

    def by_library(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(sent.value)
        for batch in batches:
            ids = [np.array(x, "<u4").tobytes() for texts in _few(batch.column(4).to_pylist()) for x in own.tool.encode(texts, num_threads=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], names=["uid", "doc_id", "chunk", "text_crc32", "ids"])

    def normal(chunk: int, part: str) -> str:
        text = part.replace(" ", SPACE)
        return text if chunk else SPACE + text

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(sent.value)
        for batch in batches:
            for k in range(len(batch)):
                chunk, part, size = (batch.column(c)[k].as_py() for c in (1, 2, 3))
                m = own.transfer(normal(chunk, part), 0, size + (chunk == 0))
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:2]), pa.array([m.tobytes()], pa.binary())], names=["uid", "chunk", "m"])

    def states(pdf):
        import pandas as pd

        own = model_of(sent.value)
        pdf = pdf.sort_values("chunk")
        e = own.edges([np.frombuffer(m).reshape(own.longest, own.longest) for m in pdf.m])
        return pd.DataFrame({"uid": pdf.uid, "chunk": pdf.chunk, "entry": e[:-1], "leave": e[1:]})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(sent.value)
        for batch in batches:
            for k in range(len(batch)):
                chunk, part, size, entry, leave = (batch.column(c)[k].as_py() for c in (2, 4, 5, 6, 7))
                ids = own.trace(normal(chunk, part), 0, size + (chunk == 0), entry, leave)
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:4]), pa.array([np.array(ids, "<u4").tobytes()], pa.binary())], names=["uid", "doc_id", "chunk", "text_crc32", "ids"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(whole, f"doc_id {doc}, ids binary, n_chunks long, text_crc32 long")
    schema = f"uid long, doc_id {doc}, chunk long, text_crc32 long"
    parts = rows.where(F.length("text") > chunk_chars).mapInArrow(split, f"{schema}, part string, size int, crossed boolean")
    giant = materialize(parts, "pieces-parts")
    dealt = giant.repartition("uid", "chunk")
    ids = dealt.where(~F.col("crossed")).select("uid", "doc_id", "chunk", "text_crc32", "part").mapInArrow(by_library, f"{schema}, ids binary")
    if scan:
        crossed = dealt.where("crossed")
        best = crossed.select("uid", "chunk", "part", "size").mapInArrow(matrices, "uid long, chunk long, m binary").groupBy("uid").applyInPandas(states, "uid long, chunk long, entry long, leave long")
        placed = crossed.join(best, ["uid", "chunk"]).select("uid", "doc_id", "chunk", "text_crc32", "part", "size", "entry", "leave")
        ids = ids.unionByName(placed.mapInArrow(traced, f"{schema}, ids binary"))
    return short.unionByName(joined(ids))


def joined(chunks: DataFrame) -> DataFrame:
    """One row for each document of several chunks; its ids are joined once, as digits."""
    several = chunks.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("chunk", F.hex("ids").alias("ids")))).alias("parts"), F.first("text_crc32").alias("text_crc32"))
    return several.select("doc_id", F.unhex(F.array_join(F.transform("parts", lambda p: p["ids"]), "")).alias("ids"), F.size("parts").cast("long").alias("n_chunks"), "text_crc32")


def decode(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``text`` for the column ``ids`` of each row, with the columns in ``keep``; a model's type is no matter here."""
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = model_of(sent.value).tool
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                out = [tool.decode(np.frombuffer(x, "<u4").tolist()) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(out, pa.string())], names=[*keep, "text"])

    return docs.select("ids", *keep).mapInArrow(run, ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", text string")
