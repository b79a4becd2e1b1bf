"""Registered queries and the SQL that they must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Cases on rows that are written here: tests hold them against their SQL, the driver never runs them.
CASES: dict[str, tuple[Callable[[Tables], DataFrame], str]] = {}


#: Bytes of shuffled rows that adaptive execution gives a task: sorts, windows and aggregates of a task hold a few times as many.
TASK_BYTES = 16 << 20
#: Partitions of an exchange before they are merged: enough for a task's bytes each up to 16 GB.
PARTITIONS = 1000


class Tables:
    """The Parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # partitions are merged up to this size, so with more rows there are more tasks and not larger ones
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
            spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(PARTITIONS))
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def case(sql: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Note a case under its function's name, with the SQL of what it must give."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        CASES[f.__name__] = (f, sql)
        return f

    return add


def values(rows, columns):
    """SQL for constant rows."""
    text = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"{x!r}::DOUBLE" if isinstance(x, float) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({', '.join(f'"{c}"' for c in columns)})"


for _family in ("telemetry", "logs", "traces", "network", "jobs", "ci", "profiles", "pages", "report", "evidence", "findings", "graphs", "acquisition", "matching", "payloads", "reports", "ci_history"):
    importlib.import_module(f"emberlens.plans.{_family}")
