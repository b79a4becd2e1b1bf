"""Exact order statistics of groups of any size, by histograms that are refined over passes.

``percentile`` keeps all distinct values of a group in one task. Here a group is a range of values and a rank in it: a pass
counts the range's rows in ``BINS`` bins, with the least and largest value of each; the bin that holds the rank is the next
range. Bins are made by monotone arithmetic, so they are in order and exact, and as both ends of a range lie in different bins
each pass narrows it. A pass meets its rows in partial counts, at most ``BINS`` rows for a group and task, and after the first
pass only rows of the chosen bins are left. Groups of up to ``MOST`` rows, whose values a task can hold, take ``percentile``
in one aggregate; both ways give the same values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed

BINS = 512
#: Rows of a side that may be broadcast after they were counted; more are joined by exchange.
SMALL = 20_000
#: Rows of a group that one task may hold.
MOST = 1 << 20


def _small(side: DataFrame) -> DataFrame:
    """A written side, broadcast where its counted rows are few."""
    return F.broadcast(side) if side.limit(SMALL + 1).count() <= SMALL else side.hint("merge")


def _magnitude(v: Column) -> Column:
    """Grows with v as its exponent does, on both sides of zero."""
    size = F.log2(F.abs(v)) + 1100
    return F.when(v == 0, 0.0).when(v < 0, -size).otherwise(size)


def select_ranks(rows: DataFrame, by: list[str], value: str, targets: DataFrame) -> DataFrame:
    """``targets`` (by, rank from 0) plus ``value``: the value at that place of the group's sorted values. Nulls have no place; NaN is the largest."""
    names = [f"_g{k}" for k in range(len(by))]
    # null groups are groups: a key that is never null stands for them
    rows = rows.select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    rows = rows.withColumn("_key", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
    ends = rows.groupBy("_key").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    wanted = targets.select(F.to_json(F.struct(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True))), {"ignoreNullFields": "false"}).alias("_key"), F.col("rank").alias("_rank")).distinct()
    # a state is a target's range and its rank among the rows of the range
    state = checkpointed(wanted.join(ends, "_key").where("_rank >= 0 AND _rank < _n").select("_key", "_rank", "_lo", "_hi", F.col("_rank").alias("_left")))
    held, done, step = rows.select("_key", "_v"), [], -1
    while True:
        step += 1
        found = F.col("_lo").eqNullSafe(F.col("_hi"))
        done.append(state.where(found).select("_key", "_rank", F.col("_lo").alias("value")))
        state = checkpointed(state.where(~found))
        if state.isEmpty():
            break
        inside = held.join(_small(state), "_key").where("_v >= _lo AND _v <= _hi")
        # infinite ends have no width: they get bins of their own
        low, high = (F.when(F.col(c).isin(float("inf"), float("-inf")) | F.isnan(c), F.lit(s * 1.7e308)).otherwise(F.col(c)) for c, s in (("_lo", -1), ("_hi", 1)))
        # even passes cut the range evenly, odd ones by magnitude: one of them soon separates values of any spread
        a, b, v = (c if step % 2 == 0 else _magnitude(c) for c in (low / 4, high / 4, F.col("_v") / 4))
        share = F.when(b > a, (v - a) / F.nullif(b - a, F.lit(0.0))).otherwise(0.5)
        bin_ = F.when(F.col("_v") == F.col("_lo"), -1).when(F.col("_v") == F.col("_hi"), BINS).otherwise(F.least(F.greatest(F.floor(share * BINS), F.lit(0)), F.lit(BINS - 1)))
        bins = inside.groupBy("_key", "_rank", "_left", bin_.cast("int").alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy("_key", "_rank").orderBy("_bin"))
        at = bins.withColumn("_upto", upto).where("_left < _upto AND _left >= _upto - _c")
        state = checkpointed(at.select("_key", "_rank", "_lo", "_hi", (F.col("_left") - F.col("_upto") + F.col("_c")).alias("_left")))
        ranges = state.select("_key", "_lo", "_hi").groupBy("_key").agg(F.min("_lo").alias("_from"), F.max("_hi").alias("_to"))
        held = checkpointed(held.join(_small(checkpointed(ranges)), "_key").where("_v >= _from AND _v <= _to").select("_key", "_v"))
    out = reduce(DataFrame.unionByName, done)
    own = targets.withColumn("_key", F.to_json(F.struct(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True))), {"ignoreNullFields": "false"}))
    return own.join(out, (own["_key"] == out["_key"]) & (own["rank"] == out["_rank"])).select(*targets.columns, "value")


def exact_percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float], most: int = MOST) -> DataFrame:
    """by, share, percentile (interpolated between neighbours, as the median of an even number is their mean) and samples."""
    rows = rows.select(*by, F.col(value).cast("double").alias("_value")).where("_value IS NOT NULL")
    sizes = checkpointed(rows.groupBy(*by).agg(F.count("*").alias("samples")))
    hot = checkpointed(sizes.where(F.col("samples") > most))
    if hot.isEmpty():
        return _in_one_pass(rows, by, shares)
    names = hot.select(*(F.col(b).alias(f"_of_{b}") for b in by), F.lit(True).alias("_hot"))
    on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by], F.lit(True))
    names = _small(checkpointed(names))
    few = rows.join(names, on, "left_anti")
    return _in_one_pass(few, by, shares).unionByName(_refined(rows.join(names, on, "left_semi"), by, hot, shares))


def _in_one_pass(rows: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    held = rows.groupBy(*by).agg(F.percentile("_value", F.array(*(F.lit(float(s)) for s in shares))).alias("_p"), F.count("*").alias("samples"))
    pairs = F.arrays_zip(F.array(*(F.lit(float(s)) for s in shares)).alias("share"), F.col("_p").alias("percentile"))
    return held.where("samples > 0").select(*by, "samples", F.explode(pairs).alias("_z")).select(*by, F.col("_z.share").alias("share"), F.col("_z.percentile").alias("percentile"), "samples")


def _refined(rows: DataFrame, by: list[str], sizes: DataFrame, shares: list[float]) -> DataFrame:
    place = (F.col("samples") - 1) * F.col("share")
    asked = sizes.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares)))).withColumns({"_low": F.floor(place).cast("long"), "_high": F.ceil(place).cast("long"), "_part": place - F.floor(place)})
    asked = checkpointed(asked)
    targets = asked.select(*by, F.explode(F.array("_low", "_high")).alias("rank")).distinct()
    out, found = asked, checkpointed(select_ranks(rows, by, "_value", targets))
    for c in ("_low", "_high"):
        side = found.select(*(F.col(b).alias(f"{c}_{b}") for b in by), F.col("rank").alias(f"{c}_rank"), F.col("value").alias(f"{c}_value"))
        out = out.join(side, reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"{c}_{b}")) for b in by], F.col(f"{c}_rank") == F.col(c)))
    # equal neighbours need no arithmetic, which infinite ones would not survive
    between = F.when(F.col("_low_value") == F.col("_high_value"), F.col("_low_value")).otherwise(F.col("_low_value") * (1 - F.col("_part")) + F.col("_high_value") * F.col("_part"))
    return out.select(*by, "share", between.alias("percentile"), "samples")


def median_and_mad(rows: DataFrame, by: list[str], value: str, most: int = MOST) -> DataFrame:
    """by, median, samples and mad, the median distance from the median; groups without values have none."""
    middle = checkpointed(exact_percentiles(rows, by, value, [0.5], most).select(*by, F.col("percentile").alias("median"), "samples"))
    named = middle.select(*(F.col(b).alias(f"_of_{b}") for b in by), F.col("median").alias("_median"))
    on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by]) if by else F.lit(True)
    off = rows.select(*by, value).join(_small(checkpointed(named)), on).select(*by, F.abs(F.col(value) - F.col("_median")).alias("_off"))
    mad = exact_percentiles(off, by, "_off", [0.5], most).select(*(F.col(b).alias(f"_of_{b}") for b in by), F.col("percentile").alias("mad"))
    return middle.join(mad, on).select(*by, "median", "samples", "mad")


def ranked(rows: DataFrame, by: list[str], order: list[Column | str], rank: str, size: str) -> DataFrame:
    """``rows`` plus ``rank``, the place from 1 in their group by ``order``, and ``size``, the group's rows: as windows by ``by`` give, without a task for a group.

    Rows are dealt by ranges of group and order, so a group lies in neighbouring partitions; its counts in them, at most one for a
    group and one for a partition more, tell where each part begins."""
    part = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    held = checkpointed(part.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    cells = held.groupBy(*by, "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cells.select(*(F.col(b).alias(f"_of_{b}") for b in by), F.col("_part").alias("_of_part"), (before - F.col("_first")).alias("_shift"), F.sum("_c").over(whole).alias(size))
    on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by], F.col("_part") == F.col("_of_part"))
    return held.join(_small(checkpointed(starts)), on).select(*rows.columns, (F.col("_at") + F.col("_shift") + 1).cast("int").alias(rank), size)
