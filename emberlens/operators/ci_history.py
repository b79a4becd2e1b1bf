"""A repository's run history: the window that a cut listing certifies, roll-ups of workflows, runs to sample, and the gate of history rules."""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import ranked

#: Fixed value: runs that wait for a maintainer ran no job.
AWAITING = "action_required"


def certified(listed: DataFrame, totals: DataFrame, repo: str, created: str) -> DataFrame:
    """Runs of each repository whose window is whole, with its start and whether that instant is left out.

    totals: repo, total (how many runs there are; fewer than listed, or null, counts as listed) and since. A listing that was cut
    may go on at its oldest instant, so only what is strictly newer than that is certain."""
    have = listed.groupBy(repo).agg(F.count("*").alias("_n"), F.min(created).alias("_oldest"))
    facts = totals.join(have, repo, "left").withColumn("_cut", F.coalesce(F.col("total") > F.col("_n"), F.lit(False)))
    facts = facts.select(repo, F.when(F.col("_cut"), F.col("_oldest")).otherwise(F.col("since")).alias("window_start"), F.col("_cut").alias("start_exclusive"))
    rows = listed.join(facts, repo)
    return rows.where(~F.col("start_exclusive") | (F.col(created) > F.col("window_start")))


def bisection_place(n: Column, i: Column) -> Column:
    """Where index i of n comes in 0, n - 1, the middle, the quarters, the eighths and so on: a number that orders as the picks do.

    At level j the picks are floor(k (n - 1) / 2**j) for odd k; i is first met at the least j and k that give it, which 2**j + k
    puts in order. After the level that is finer than half an index, what was never met follows in order."""

    @F.pandas_udf("long")
    def place(n: pd.Series, i: pd.Series) -> pd.Series:
        n, i = n.to_numpy(np.int64), i.to_numpy(np.int64)
        last, finest = np.maximum(n - 1, 1), np.ceil(np.log2(2.0 * n + 1))
        out = (1 << 62) + i
        for j in range(int(finest.max(initial=0)), 0, -1):
            odd = (i * (1 << j) + last - 1) // last | 1
            met = (odd < ((i + 1) * (1 << j) + last - 1) // last) & (odd < 1 << j) & (j <= finest)
            out = np.where(met, (1 << j) + odd, out)
        return pd.Series(np.where(i == 0, 0, np.where(i == n - 1, 1, out)))

    return place(n, i)


def sampling_turns(runs: DataFrame, repo: str, path: str, order: list[Column | str], status: str, conclusion: str) -> DataFrame:
    """Completed runs that ran jobs, with ``turn`` (of their workflow) and ``place`` (of all): workflows take turns, busiest first, and a
    workflow's picks are spread over the window. ``order`` is the listing's, newest first."""
    ran = runs.where((F.col(status) == "completed") & ~F.col(conclusion).eqNullSafe(F.lit(AWAITING)))
    rows = ranked(ran, [repo, path], order, "_i", "_n")
    rows = ranked(rows.withColumn("_pick", bisection_place(F.col("_n"), F.col("_i") - 1)), [repo, path], ["_pick"], "turn", "_m").drop("_i", "_pick", "_m")
    return ranked(rows, [repo], ["turn", F.desc("_n"), path], "place", "_m").drop("_n", "_m")


def workflow_rollup(runs: DataFrame, repo: str, path: str, status: str, conclusion: str, event: str, attempt: str) -> DataFrame:
    """Runs of each workflow: completed, executed, awaiting, retried, and counts by conclusion (or status) and by event, most common first."""
    done = F.col(status) == "completed"
    waits = F.coalesce(done & (F.col(conclusion) == AWAITING), F.lit(False))
    key = [repo, path]
    agg = runs.groupBy(*key).agg(F.count("*").alias("runs"), F.count_if(done).alias("completed"), F.count_if(done & ~waits).alias("executed"), F.count_if(waits).alias("awaiting"), F.count_if(F.coalesce(F.col(attempt), F.lit(1)) > 1).alias("retried"))

    def counts(value: Column, name: str) -> DataFrame:
        per = runs.select(*key, F.coalesce(value, F.lit("None")).alias("_v")).groupBy(*key, "_v").agg(F.count("*").alias("_c"))
        listed = F.array_sort(F.collect_list(F.struct((-F.col("_c")).alias("m"), F.col("_v").alias("value"), F.col("_c").alias("n"))))
        return per.groupBy(*key).agg(F.transform(listed, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias(name))

    return reduce(lambda a, b: a.join(b, key, "left"), [agg, counts(F.coalesce(F.nullif(F.col(conclusion), F.lit("")), F.col(status)), "by_conclusion"), counts(F.col(event), "by_event")])


def gated(found: DataFrame, runs: DataFrame, workflow: str, run: str, min_runs: int = 5) -> DataFrame:
    """A history rule's rows with ``runs`` and, under ``min_runs`` distinct runs of the workflow, no verdict: omitted, never clean."""
    per = runs.groupBy(workflow).agg(F.countDistinct(run).alias("_runs"))
    out = found.drop("runs").join(per, workflow, "left").withColumn("runs", F.coalesce("_runs", F.lit(0)).cast("long")).drop("_runs")
    few = F.col("runs") < min_runs
    out = out.withColumn("status", F.when(few, "omitted").otherwise(F.col("status")))
    return out.withColumn("confidence", F.when(~few, F.col("confidence"))) if "confidence" in found.columns else out
