"""Line dedup: repeated runs of lines, found by distributed prefix doubling over the sequences of line ids.

A line with a word gets a 64-bit hash of its bytes as id; a document is its sequence of ids, and no run crosses its end.
Level 0 keeps positions whose line occurs twice or more. Level k + 1 sorts the distinct pairs (rank of 2**k lines here,
rank of 2**k lines further on) over range partitions and ranks those that occur twice or more: ranks are suffix array
ranks truncated to that depth, equal where the longest common prefix reaches it. Before each step, positions are thinned
to stretches of consecutive ones that have ``min_words`` words together: no shorter stretch can hold a run that counts. So
levels shrink fast, and the partner of a position is found in its stretch, without a join.

A repeated run counts when it has ``min_words`` words. Its lines are those of its shortest sufficient parts, forward
from a line and backward from a line, and such a part of m lines is an LCP interval of depth m: it is identified by the
ranks of its first and its last 2**k lines, k the largest with 2**k <= m. In every interval the first occurrence, by
doc_id and line, stays, and the lines of later ones are deleted. A later one that overlaps the first in its document loses
the lines behind the first's end only, so text that repeats itself keeps its first ``min_words`` words. Shorter runs, such
as a licence line, stay. Depth ends where the longest shortest part does, at ``min_words`` lines of one word.

Defined results: a null or empty text has no lines and stays; lines without words count for nothing and stay; a very long
text is cut into its lines in one pass and its positions are sorted, not held together; ties of
doc_id go to the row read first, and rows without doc_id come last; copies keep their first row's lines; an empty table
gives an empty result; other columns pass through unchanged, except that columns named as the two counts are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, ranked, slices, span_hashes, text_buffers, tune, unused, word_spans


def line_rows(docs: DataFrame, uid: str, min_words: int) -> DataFrame:
    """uid, doc_id, pos (among lines with words), line, h, the ends of the shortest sufficient parts from (fwd) and to (bwd) here, and the document's words before and up to the line's end.

    fwd and bwd are numbers of lines, 0 where the document has too few words on that side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for a, b in slices(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                breaks = np.flatnonzero(part == 10)
                # a line ends at a break or at its document's end
                starts = np.sort(np.concatenate([off[:-1], breaks + 1]))
                ends = np.sort(np.concatenate([breaks, off[1:]]))
                row = np.repeat(np.arange(b - a), 1 + np.diff(np.searchsorted(breaks, off)))
                w_start, _, _ = word_spans(part, off)
                words = np.searchsorted(w_start, ends) - np.searchsorted(w_start, starts)
                number = np.arange(len(row)) - np.searchsorted(row, row)
                full = words > 0
                starts, ends, row, words, number = starts[full], ends[full], row[full], words[full], number[full]
                if not len(row):
                    continue
                pos = np.arange(len(row)) - np.searchsorted(row, row)
                total = np.concatenate([[0], np.cumsum(words)])
                first, last = np.searchsorted(row, row), np.searchsorted(row, row, "right")
                at = np.arange(len(row))
                to = np.searchsorted(total, total[at] + min_words)  # fewest lines from here: [at, to)
                since = np.searchsorted(total, total[at + 1] - min_words, "right") - 1  # fewest lines to here: [since, at]
                fwd, bwd = np.where(to <= last, to - at, 0), np.where(since >= first, at + 1 - since, 0)
                bwd[total[at + 1] < min_words] = 0
                doc, begin = pa.array(row + a), total[first]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), *(pa.array(x.astype(np.int32)) for x in (pos, number)), pa.array(span_hashes(part, starts, ends).view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (fwd, bwd, total[at] - begin, total[at + 1] - begin))], names=["uid", "doc_id", "pos", "line", "h", "fwd", "bwd", "before", "upto"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(uid, "doc_id", F.col("text").cast("string")).mapInArrow(run, f"uid long, doc_id {kind}, pos int, line int, h long, fwd int, bwd int, before int, upto int")


def _thinned(level: DataFrame, step: int, min_words: int, name: str) -> DataFrame:
    """uid, pos, rank, second (the rank ``step`` lines further on), before, upto and last, where the stretch of consecutive positions has ``min_words`` words."""
    stretch = Window.partitionBy("uid", "run")
    held = level.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("uid").orderBy("pos")))
    held = held.withColumn("words", F.max("upto").over(stretch) - F.min("before").over(stretch)).where(F.col("words") >= min_words)
    ahead = lambda c: F.lead(c, step).over(stretch.orderBy("pos"))
    return materialize(held.select("uid", "pos", "rank", ahead("rank").alias("second"), "before", ahead("upto").alias("reach")), name)


def doubled(live: DataFrame, most: int, min_words: int) -> list[DataFrame]:
    """Per level k, uid, pos and rank of the repeated stretches of 2**k lines; live: uid, pos, rank, before, upto."""
    levels = [_thinned(live, 1, min_words, "lines-level0")]
    while most >= 2 << (len(levels) - 1):
        k = len(levels)
        pairs = levels[-1].where("second IS NOT NULL").select("uid", "pos", F.col("rank").alias("first"), "second", "before", F.col("reach").alias("upto"))
        repeated = pairs.groupBy("first", "second").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        level = pairs.join(ranked(repeated, ["first", "second"], f"lines-ranks{k}"), ["first", "second"]).select("uid", "pos", "rank", "before", "upto")
        level = _thinned(level, 1 << k, min_words, f"lines-level{k}")
        if level.isEmpty():
            break
        levels.append(level)
    return levels


def repeated_parts(levels: list[DataFrame], parts: DataFrame) -> DataFrame:
    """uid and the lines [pos, until) of parts that occurred before, without those of the first occurrence; parts: uid, doc_id, pos, m."""
    every = None
    for k, level in enumerate(levels):
        own = parts.where((F.col("m") >= 1 << k) & (F.col("m") < 2 << k))
        named = own.join(level.select("uid", "pos", F.col("rank").alias("first")), ["uid", "pos"])
        last = level.select("uid", F.col("pos").alias("at"), F.col("rank").alias("last"))
        named = named.withColumn("at", F.col("pos") + F.col("m") - (1 << k)).join(last, ["uid", "at"])
        named = named.withColumn("here", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid", "pos")).select("first", "last", "m", "here", "uid", "pos")
        every = named if every is None else every.unionByName(named)
    # written first, so that the join's sides are plain exchanges, whose hot parts Spark can split; m tells the level
    named = materialize(every, "lines-parts")
    origin = named.groupBy("first", "last", "m").agg(F.min("here").alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    return named.join(materialize(origin, "lines-origin"), ["first", "last", "m"]).where("here > origin").select("uid", F.when(F.col("origin.uid") == F.col("uid"), F.greatest("pos", F.col("origin.pos") + F.col("m"))).otherwise(F.col("pos")).alias("pos"), (F.col("pos") + F.col("m")).alias("until")).where("pos < until")


def dedup(docs: DataFrame, min_words: int = 50, counts: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from ``text``, and the two counts of lines and of deleted lines.

    Lines are counted as they stand between line breaks, those without words included."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.drop(*counts)
    uid, gone, split = unused(docs, "_uid", "_gone", "_split")
    held = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "lines-docs")
    lines = materialize(line_rows(held, uid, min_words), "lines-rows")
    repeated = materialize(lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "lines-repeated")
    live = materialize(lines.join(repeated, "h").withColumnRenamed("h", "rank"), "lines-live")
    discard(lines)
    most = live.agg(F.greatest(F.max("fwd"), F.max("bwd")).alias("m")).first().m or 0
    levels = doubled(live.select("uid", "pos", "rank", "before", "upto"), most, min_words)
    whole = live.join(levels[0].select("uid", "pos"), ["uid", "pos"], "left_semi").select("uid", "doc_id", "pos", "fwd", "bwd")
    parts = F.array(F.struct("pos", F.col("fwd").alias("m")), F.struct((F.col("pos") - F.col("bwd") + 1).alias("pos"), F.col("bwd").alias("m")))
    parts = whole.select("uid", "doc_id", F.explode(parts).alias("p")).select("uid", "doc_id", "p.pos", "p.m").where("m > 0").distinct()
    found = repeated_parts(levels, materialize(parts, "lines-all-parts")).groupBy("uid", "pos").agg(F.max("until").alias("until"))
    reach = F.max("until").over(Window.partitionBy("uid").orderBy("pos"))
    deleted = live.select("uid", "pos", "line").join(found, ["uid", "pos"], "left").withColumn("reach", reach).where("reach > pos")
    by_doc = deleted.groupBy(F.col("uid").alias(uid)).agg(F.collect_list("line").alias(gone))
    joined = held.join(by_doc.hint("shuffle_hash"), uid, "left")
    text = F.col("text").cast("string")
    # lines as a column of their own, so that each is looked up in place
    rows = joined.withColumn(split, F.split(text, "\n", -1))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone)), lambda i: F.col(split)[i])
    edited = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n"))
    columns = [edited.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns, F.coalesce(F.size(split), F.lit(0)).cast("long").alias(counts[0]), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(counts[1]))
