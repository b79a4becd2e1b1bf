"""Compression bands: zstandard ratios over whole documents and fixed chunks, with limits that depend on length.

A ratio is compressed bytes over UTF-8 bytes. Short texts compress badly because a frame has fixed costs and no history,
so each length has its own band: below it a text repeats itself, above it it is noise. Documents of a chunk or more are
also cut into fixed chunks, the last one moved back to end with the text, so that a repetitive or random stretch inside good text shows; a document is rejected when more than
``max_bad_chunks`` of its chunks leave the chunk band.

Defined results: a null or empty text has no words, fails the base rule and has ratio 0; ties, copies and repeated rows
are judged separately and alike; an empty table gives an empty result; other columns are not read. Whole texts are
read, in slices of bounded size, and no rows are exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, runs_of, slices, span_hashes, text_buffers, tune, word_spans

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """(from this many bytes on, lowest ratio, highest ratio) by document length, and the same for chunks."""

    document: tuple[tuple[int, float, float], ...] = ((0, 0.0, 2.0), (200, 0.40, 0.95), (500, 0.43, 0.82), (1000, 0.42, 0.70), (2000, 0.39, 0.62), (8000, 0.37, 0.56), (32000, 0.34, 0.54))
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.15, 0.75)
    max_bad_chunks: float = 0.34
    level: int = 3
    min_words: int = 50
    max_repeat: float = 0.5

    def band(self, n_bytes: int) -> tuple[float, float]:
        return next((lo, hi) for least, lo, hi in reversed(self.document) if n_bytes >= least)


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols and n_repeat_words of each row."""
    rows = len(offsets) - 1
    starts, ends, row = word_spans(data, offsets)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])
    grams, first = runs_of(span_hashes(data, starts, ends), row, 3)
    keyed = grams ^ (row[first].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keyed, kind="stable")
    same = keyed[order[1:]] == keyed[order[:-1]]
    twice = first[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(order) else first
    covered = np.zeros(len(starts) + 2, bool)
    for k in range(3):
        covered[twice + k] = True
    return {
        "n_words": np.bincount(row, minlength=rows), "word_chars": count(~SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": count(SYMBOLS[data]), "n_repeat_words": np.bincount(row[covered[: len(row)]], minlength=rows),
    }


def duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip(WHITE):
            n += line in seen
            seen.add(line)
    return n


def ratios(raw: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    """The document's ratio, its chunks, the last one ending with the text, and those out of band."""
    if not raw:
        return 0.0, 0, 0
    whole = len(press.compress(raw)) / len(raw)
    step, chunks, bad = bands.chunk_bytes, 0, 0
    if len(raw) >= step:
        for at in sorted({*range(0, len(raw) - step + 1, step), len(raw) - step}):
            r = len(press.compress(raw[at : at + step])) / step
            chunks += 1
            bad += not bands.chunk[0] <= r <= bands.chunk[1]
    return whole, chunks, bad


def judge(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, ratios and verdicts of each document."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                off = offsets[a : b + 1] - offsets[a]
                part = data[offsets[a] : offsets[b]]
                c = text_counts(part, off)
                raws = [part[off[i] : off[i + 1]].tobytes() for i in range(b - a)]
                got = [ratios(x, bands, press) for x in raws]
                whole, chunks, bad = (np.array([g[k] for g in got]) for k in range(3))
                lo, hi = np.array([bands.band(len(x)) for x in raws]).T
                failed = (c["n_words"] < bands.min_words) | (c["n_repeat_words"] > bands.max_repeat * c["n_words"])
                inside = (whole >= lo) & (whole <= hi) & (bad <= bands.max_bad_chunks * chunks)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in (c["n_words"], c["word_chars"], c["n_symbols"])),
                     pa.array([duplicate_lines(x) for x in raws], pa.int64()), pa.array(c["n_repeat_words"].astype(np.int64)),
                     pa.array(failed), pa.array(~failed & inside), pa.array(whole.astype(float)), pa.array(chunks.astype(np.int64)), pa.array(bad.astype(np.int64))],
                    names=names,
                )

    kind = docs.schema[id_col].dataType.simpleString()
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = [id_col, *longs, "base_failed", "kept", "ratio", "n_chunks", "n_bad_chunks"]
    schema = f"{id_col} {kind}, " + ", ".join(f"{x} long" for x in longs) + ", base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
