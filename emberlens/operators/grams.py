"""Which of many patterns stand in which of many texts: a gram index turns containment into an equi-join with a residual.

A window of ``WINDOW`` grams of ``GRAM`` bytes has one least gram by hash, the same wherever the window stands. A text gives the
least grams of all its windows, about two in ``WINDOW + 1`` of its bytes; a pattern needs one of its own, so it takes the one
that the fewest texts hold. Shorter patterns than a window use a second index of all grams of ``SHORT`` bytes, and the
shortest a third of all grams of their length; texts give these grams only where such patterns exist. Candidates share the gram; the
pattern is then looked for in the text itself. Texts that hold no chosen gram are never sent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed

GRAM, WINDOW, SHORT = 12, 24, 6
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` successive bytes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _MULTIPLIER + data[k : k + n].astype(np.uint64) + np.uint64(1)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def least_grams(data: np.ndarray, size: int, window: int) -> np.ndarray:
    """Distinct least hashes of the windows of ``window`` grams; none where the text is shorter than a window."""
    h = gram_hashes(data, size)
    if len(h) < window:
        return np.empty(0, np.uint64)
    # the least of each window from the least of its halves, doubling
    least, have = h, 1
    while have < window:
        step = min(have, window - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return np.unique(least)


def _length_class(n_bytes: int) -> int:
    """0 for patterns of a window, 1 for those of a short gram, 2 + n for shorter ones of n bytes."""
    return 0 if n_bytes >= GRAM + WINDOW - 1 else 1 if n_bytes >= SHORT else 2 + n_bytes


def _grams(data: np.ndarray, kind: int) -> np.ndarray:
    return least_grams(data, GRAM, WINDOW) if kind == 0 else np.unique(gram_hashes(data, SHORT if kind == 1 else kind - 2))


def grams(rows: DataFrame, key: str, text: str, kinds: list[int] | None) -> DataFrame:
    """key, kind and hash of the grams that rows give: of all ``kinds``, or each of its own as a pattern. Slices of long texts overlap by a window."""
    at_once = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                raw = np.frombuffer((value.as_py() or "").encode(), np.uint8)
                for kind in kinds if kinds is not None else [_length_class(len(raw))] if len(raw) else []:
                    for at in range(0, max(len(raw), 1), at_once):
                        h = _grams(raw[at : at + at_once + GRAM + WINDOW], kind)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(h), pa.int64())), pa.array([kind] * len(h), pa.int32()), pa.array(h.view(np.int64))], names=[key, "kind", "h"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, kind int, h long")


def contained(texts: DataFrame, key: str, text: str, patterns: DataFrame, name: str, pattern: str) -> DataFrame:
    """key and name for each row of texts and row of patterns that it holds; empty patterns and nulls are held by none.

    Patterns are told apart by their text, and texts meet their candidates by null-safe keys and are looked through again, so
    keys and names may repeat and be null."""
    own = patterns.select(name, F.col(pattern).cast("string").alias("_pattern"))
    wanted = checkpointed(grams(own.select(F.col("_pattern").alias("_p"), "_pattern").distinct(), "_p", "_pattern", None).distinct())
    kinds = [r.kind for r in wanted.select("kind").distinct().collect()]  # at most SHORT + 2
    posting = checkpointed(grams(texts, key, text, kinds).distinct().join(wanted.select("kind", "h").distinct(), ["kind", "h"], "left_semi")) if kinds else None
    if posting is None:
        return texts.select(key).join(patterns.select(name).where("false"))
    held = posting.groupBy("kind", "h").agg(F.count("*").alias("n"))
    # a pattern without a text that holds each of its grams stands in none; else its rarest gram speaks for it
    choice = wanted.join(held, ["kind", "h"], "left").groupBy("_p").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "kind", "h")).alias("c")).where("c.n > 0")
    candidates = checkpointed(posting.join(choice.select("_p", "c.kind", "c.h"), ["kind", "h"]).select(F.col(key).alias("_key"), "_p"))
    both = candidates.join(texts.select(key, F.col(text).alias("_text")), F.col("_key").eqNullSafe(F.col(key))).where(F.contains("_text", "_p"))
    return both.join(own, F.col("_p") == F.col("_pattern")).select(key, name)


def undropped(probes: DataFrame, probe: str, path: str, filters: DataFrame, filter_id: str, pattern: str) -> DataFrame:
    """OBS-13: probes whose path holds no pattern of any filter; each row is judged by its own path, whatever its id."""
    digest = F.unhex(F.md5(F.col(path).cast("binary")))
    paths = probes.select(digest.alias("_path"), path)
    hit = contained(paths, "_path", path, filters, filter_id, pattern).select("_path").distinct()
    return probes.withColumn("_path", digest).join(hit, "_path", "left_anti").select(*probes.columns)
