"""CI run history: re-runs, flaky jobs, brown builds, unchanged schedules, serial chains, and the energy of runs.

Attempts are rows (run, attempt, job, conclusion, sha, started, ended); everything is a window or an aggregate over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contract import status
from .quantiles import exact_percentiles, ranked
from .traces import previous

# Ranges (low, high) of the energy model.
WATTS_PER_VCPU = (0.78, 3.76)
PUE = (1.125, 1.185)
CARBON_KG_PER_KWH = (0.322167, 0.426254)
WATER_ON_SITE = 0.34
WATER_OFF_SITE = (0.34, 2.51)
LITRES_PER_GALLON = 3.785


def rechecks(attempts: DataFrame, workflow: str, sha: str, run: str, order: list[str], conclusion: str, least: int = 2) -> DataFrame:
    """CI-01: the most re-runs after a failed attempt that one sha of a workflow had."""
    rows = attempts.select(workflow, sha, (previous(conclusion, [run], order) == "failure").alias("again"))
    per = rows.groupBy(workflow, sha).agg(F.count_if("again").alias("rechecks"))
    out = per.groupBy(workflow).agg(F.max("rechecks").alias("max_rechecks"), F.sum("rechecks").alias("rechecks"))
    return out.withColumn("status", F.when(F.col("max_rechecks") >= least, "detected").otherwise("clean")).withColumn("confidence", F.when(F.col("max_rechecks") >= 2 * least, "high").when(F.col("max_rechecks") >= least, "medium"))


def blind_rechecks(attempts: DataFrame, workflow: str, run: str, order: list[str], conclusion: str, least: int = 2) -> DataFrame:
    """CI-02: runs where an attempt failed right after a failed one."""
    rows = attempts.select(workflow, run, ((previous(conclusion, [run], order) == "failure") & (F.col(conclusion) == "failure")).alias("blind"))
    per = rows.groupBy(workflow, run).agg(F.bool_or("blind").alias("blind"))
    out = per.groupBy(workflow).agg(F.count("*").alias("runs"), F.count_if("blind").alias("blind_runs"))
    return out.withColumn("status", F.when(F.col("blind_runs") >= least, "detected").otherwise("clean"))


def flaky(attempts: DataFrame, workflow: str, run: str, attempt: str, conclusion: str, least: int = 2, min_runs: int = 5) -> DataFrame:
    """CI-03 and CI-05: runs that failed first and passed later."""
    failed = F.min(F.when(F.col(conclusion) == "failure", F.col(attempt)))
    passed = F.max(F.when(F.col(conclusion) == "success", F.col(attempt)))
    per = attempts.groupBy(workflow, run).agg((passed > failed).alias("flaky"))
    out = per.groupBy(workflow).agg(F.count("*").alias("runs"), F.count_if("flaky").alias("flaky_runs"))
    return out.withColumn("status", status(F.col("runs") >= min_runs, F.col("flaky_runs") >= least)).withColumn("confidence", F.when((F.col("flaky_runs") >= least) & (4 * F.col("flaky_runs") >= F.col("runs")), "high").when(F.col("flaky_runs") >= least, "medium"))


def unchanged_schedules(runs: DataFrame, workflow: str, order: list[str], sha: str, least: int = 3) -> DataFrame:
    """CI-12: scheduled runs on the sha of the scheduled run before."""
    rows = runs.select(workflow, (previous(sha, [workflow], order) == F.col(sha)).alias("same"))
    out = rows.groupBy(workflow).agg(F.count("*").alias("runs"), F.count_if("same").alias("unchanged"))
    return out.withColumn("status", F.when(F.col("unchanged") >= least, "detected").otherwise("clean"))


def chains(jobs: DataFrame, run: str, job: str, start: str, end: str, most_gap: float, least_seconds: float, needs: DataFrame | None = None) -> DataFrame:
    """CI-18: job pairs of a run where one starts within ``most_gap`` after the other ends; the median length over runs.

    With ``needs`` (job_a, job_b), pairs are those edges. Otherwise a pair meets in the time cell, as wide as the gap, where
    its second job starts: the first job stands in the cell of its end and the next one, so a run's jobs are not all paired."""
    a = jobs.select(run, F.col(job).alias("job_a"), F.col(start).alias("a_start"), F.col(end).alias("a_end"))
    b = jobs.select(run, F.col(job).alias("job_b"), F.col(start).alias("b_start"), F.col(end).alias("b_end"))
    if needs is not None:
        both = a.join(needs.select("job_a", "job_b").distinct(), "job_a").join(b, [run, "job_b"])
    else:
        cell = lambda c: F.floor(F.col(c) / most_gap)
        both = a.withColumn("cell", F.explode(F.array(cell("a_end"), cell("a_end") + 1))).join(b.withColumn("cell", cell("b_start")), [run, "cell"])
    both = both.where((F.col("job_a") != F.col("job_b")) & (F.col("b_start") - F.col("a_end")).between(0, most_gap))
    took = both.select("job_a", "job_b", (F.col("b_end") - F.col("a_start")).alias("_took"))
    out = exact_percentiles(took, ["job_a", "job_b"], "_took", [0.5]).select("job_a", "job_b", F.col("samples").alias("runs"), F.round("percentile", 4).alias("median_seconds"))
    return out.withColumn("status", F.when(F.col("median_seconds") >= least_seconds, "detected").otherwise("clean"))


def energy(vcpu_seconds: Column, side: int) -> Column:
    """Watt-hours, low (0) or high (1); null stays unknown."""
    return vcpu_seconds / 3600 * WATTS_PER_VCPU[side] * PUE[side]


def carbon(wh: Column, side: int) -> Column:
    """Grams of CO2 equivalent."""
    return wh / 1000 * CARBON_KG_PER_KWH[side] * 1000


def water(wh: Column, side: int) -> tuple[Column, Column]:
    """Millilitres on site and off site."""
    return wh / PUE[side] * WATER_ON_SITE, wh * round(WATER_OFF_SITE[side] * LITRES_PER_GALLON, 4)


def impact_ranges(jobs: DataFrame, by: list[str], vcpu_seconds: str, known: Column) -> DataFrame:
    """Energy, carbon and water by group; one job without a known runner makes its group unknown, not smaller."""
    agg = jobs.groupBy(*by).agg(F.count("*").alias("jobs"), F.bool_and(known).alias("_all"), F.sum(vcpu_seconds).alias("_s"))
    out = agg
    for side, name in enumerate(("low", "high")):
        wh = F.when(F.col("_all"), energy(F.col("_s"), side))
        out = out.withColumn(f"wh_{name}", F.round(wh, 3)).withColumn(f"co2e_g_{name}", F.round(carbon(wh, side), 3)).withColumn(f"water_ml_{name}", F.round(sum(water(wh, side)[1:], water(wh, side)[0]), 3))
    return out.drop("_all", "_s")


def impact_summary(runs: DataFrame, workflow: str, executed: Column, measured: str, sampled: Column | None = None) -> DataFrame:
    """Mean of the sampled runs times the count of executed ones: 0 without executed runs, unknown without a sample.

    A run that was ``sampled`` and has no measure ran on unknown hardware, and makes its workflow unknown."""
    sampled = F.col(measured).isNotNull() if sampled is None else sampled
    own = executed & sampled
    agg = runs.groupBy(workflow).agg(F.count("*").alias("runs"), F.count_if(executed).alias("executed"), F.count_if(own).alias("sampled"), F.count(F.when(own, F.col(measured))).alias("_known"), F.sum(F.when(own, F.col(measured))).alias("_sum"))
    whole = (F.col("sampled") > 0) & (F.col("_known") == F.col("sampled"))
    estimate = F.when(F.col("executed") == 0, F.lit(0.0)).when(whole, F.round(F.col("_sum") * F.col("executed") / F.col("sampled"), 2))
    return agg.withColumn("estimate", estimate).drop("_sum", "_known")


def sampling_order(runs: DataFrame, workflow: str, order: list[str], depth: int) -> DataFrame:
    """Runs to sample: workflows take turns, larger ones first, and each one's picks are spread by bisection.

    The bisection rank of a position is the bit reversal of its place in ``depth`` halvings, so it needs no table."""
    size = 1 << depth
    rows = ranked(runs.select(workflow, *order), [workflow], order, "_i", "_n").withColumn("_i", F.col("_i") - 1)
    rows = rows.withColumn("_c", F.expr(f"CAST((_i * {size}) DIV _n AS int)")).withColumn("_r", F.conv(F.reverse(F.lpad(F.bin("_c"), depth, "0")), 2, 10).cast("int"))
    return ranked(rows, [workflow], ["_r", "_i"], "turn", "_m").select(workflow, *order, F.col("_n").alias("runs"), "turn")
