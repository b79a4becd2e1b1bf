"""Shared pieces: scratch tables in the cluster's shared folder, Arrow text buffers, word hashing and distributed ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than these.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes handled at once by the numpy kernels; a longer document is handled whole.
CHUNK_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_powers: dict[str, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Python workers give freed arrays back to the system instead of keeping them for the next task.
WORKER_ENV = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(2 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def tune(spark: SparkSession) -> None:
    """Small batches keep the memory of executors and of their Python workers flat however long the rows are."""
    for name, value in WORKER_ENV.items():
        spark.sparkContext.environment.setdefault(name, value)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; on a single machine without one, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="emberlens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has it."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        out.append(name)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind ``materialize``d rows that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the marks that tell rows apart without a shuffle, as a power of two: at most 2**19 broadcast rows of 64 bits.
MARK_BITS = 25


def _mark(ids: Column) -> tuple[Column, Column]:
    """Word and bit of an id among the marks."""
    h = F.xxhash64(ids)
    return F.shiftrightunsigned(h, 64 - MARK_BITS + 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 64 - MARK_BITS).bitwiseAND(63).cast("int"))


def marked(df: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """``df`` plus ``name``: true wherever ``column`` is among ``ids`` (of one column), null too, and for few others.

    No row of ``df`` is shuffled: what must be exact joins the marked rows again."""
    at, held, bits = unused(df, "at", "word", "bits")
    word, bit = _mark(F.col(ids.columns[0]))
    marks = ids.select(word.alias(held), bit.alias(bits)).groupBy(held).agg(F.bit_or(bits).alias(bits))
    word, bit = _mark(F.col(f"`{column}`"))
    joined = df.withColumn(at, word).join(F.broadcast(marks), F.col(at) == F.col(held), "left")
    return joined.withColumn(name, F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))).drop(at, held, bits)


def packed(values: np.ndarray) -> bytes:
    """Integers as byte planes, each compressed: what random planes hold stays, what is nearly constant goes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    parts = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) if p.any() else b"" for p in planes]
    return np.array([len(values), *map(len, parts)], np.uint32).tobytes() + b"".join(parts)


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    """The integers of ``packed``."""
    width = np.dtype(kind).itemsize
    n, *sizes = np.frombuffer(blob, np.uint32, width + 1).tolist()
    planes, at = np.zeros((width, n), np.uint8), 4 * (width + 1)
    for k, size in enumerate(sizes):
        if size:
            planes[k] = np.frombuffer(pa.decompress(blob[at : at + size], decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
        at += size
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return data[lo:hi], offsets - lo


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer row."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a row's end also ends a word."""
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        steps = np.full(max(n, CHUNK_BYTES + 4096), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes, ``fold`` lower-cases A-Z: differences of one running polynomial, so linear in the bytes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, lo + CHUNK_BYTES, "right")))
        hi = int(ends[at:stop].max())
        part = (_FOLDED if fold else _BYTES)[data[lo:hi]] * _power("up", hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = (total[e] - total[s]) * _power("down", hi - lo)[s] + (e - s).astype(np.uint64)
        at = stop
    return mix(out)


def runs_of(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order-sensitive hashes of the n-word windows that stay within a row, and the first word of each."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(rows[:count] == rows[n - 1 :])
    value = hashes[first]
    for k in range(1, n):
        value = value * np.uint64(_BASE) + hashes[first + k]
    return mix(value), first


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` plus ``rank`` from 0 in the given total order, by a range-partitioned sort; written to the shared folder.

    Only one count for each partition reaches the driver."""
    part = df.repartitionByRange(*order).sortWithinPartitions(*order)
    part = part.select("*", F.monotonically_increasing_id().alias("_at"))
    held = materialize(part, name)
    pid, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = {r.pid: r.n for r in held.groupBy(pid.alias("pid")).agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for k in sorted(sizes):
        starts.append((k, at))
        at += sizes[k]
    spark = df.sparkSession
    begin = spark.createDataFrame(starts, "pid long, _begin long")
    out = held.withColumn("pid", pid).join(F.broadcast(begin), "pid").withColumn("rank", F.col("_begin") + local)
    return out.drop("pid", "_begin", "_at")
