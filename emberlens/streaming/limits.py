"""Requests under a cooldown for each key and a daily cap for each scope: the same fold over a sorted table and over a stream.

A request is too soon when its key started less than ``cooldown`` seconds before; else it is over the cap when its scope
started ``daily`` requests that day; else it takes a slot, which it gives back where it can't start. Only starts count: a
refused or failed request changes nothing, so what a request gets depends on all before it, which no window gives.

What is remembered is bounded: the day's count and the keys started within the cooldown, at most ``daily`` a day. So the
table's fold streams through sorted partitions with that state alone. Starts of one scope are one sequence, however many
tasks there are; scopes are what spreads them. The stream keeps requests until the watermark has passed them and folds them in the
order of time when a timer fires, so its verdicts don't depend on the order of arrival within the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000
DAY = 86_400 * MICROS


class Limits:
    """The fold's state for one scope. Times are microseconds."""

    def __init__(self, cooldown: float, daily: int, day: int = -1, count: int = 0, started: dict[str, int] | None = None) -> None:
        self.cooldown, self.daily, self.day, self.count, self.started = round(cooldown * MICROS), daily, day, count, started or {}

    def verdict(self, key: str, at: int, starts: bool) -> str:
        if at // DAY != self.day:
            self.day, self.count = at // DAY, 0
            self.started = {k: t for k, t in self.started.items() if at - t < self.cooldown}
        last = self.started.get(key)
        if last is not None and at - last < self.cooldown:
            return "too soon"
        if self.count >= self.daily:
            return "over the cap"
        if not starts:
            return "failed"
        self.count += 1
        self.started[key] = at
        return "started"


def within_limits(requests: DataFrame, scope: str, key: str, at: str, order: str, starts: str, cooldown: float, daily: int) -> DataFrame:
    """scope, order (what sets requests of one time apart) and verdict. A null scope is one; requests without a time have no verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for own, name, time, ok in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if state is None or own != now:
                    now, state = own, Limits(cooldown, daily)
                out.append(None if time is None else state.verdict(name, time, ok))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=[scope, order, "verdict"])

    kinds = {c: requests.schema[c].dataType.simpleString() for c in (scope, order)}
    rows = requests.select(scope, order, F.col(key).cast("string").alias("_key"), F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.coalesce(F.col(starts), F.lit(False)).alias("_starts"))
    rows = rows.repartition(scope).sortWithinPartitions(scope, "_at", order)
    return rows.mapInArrow(run, f"{scope} {kinds[scope]}, {order} {kinds[order]}, verdict string")


class _Judge(StatefulProcessor):
    """Requests wait for the watermark; a timer at the earliest one folds all that it has passed."""

    def __init__(self, cooldown: float, daily: int) -> None:
        self.cooldown, self.daily = cooldown, daily

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long, key string, at long, starts boolean")
        self.started = handle.getMapState("started", "key string", "at long")
        self.day = handle.getValueState("day", "day long, count long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.waiting.appendList([(int(r.id), str(r.key), int(r.micros), bool(r.starts)) for r in part.itertuples(index=False)])
        self._wake()
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted(self.waiting.get(), key=lambda r: (r[2], r[0])) if self.waiting.exists() else []
        due = [r for r in every if r[2] <= passed]
        day, count = self.day.get() if self.day.exists() else (-1, 0)
        before = {k[0]: v[0] for k, v in self.started.iterator()}
        state = Limits(self.cooldown, self.daily, day, count, dict(before))
        out = [(key[0], r[0], state.verdict(r[1], r[2], r[3])) for r in due]
        self.day.update((state.day, state.count))
        for k in before.keys() - state.started.keys():
            self.started.removeKey((k,))
        for k, t in state.started.items():
            if before.get(k) != t:
                self.started.updateValue((k,), (t,))
        self.waiting.put([r for r in every if r[2] > passed])
        self._wake()
        if out:
            yield pd.DataFrame(out, columns=["scope", "id", "verdict"])

    def _wake(self) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        first = min((r[2] for r in self.waiting.get()), default=None) if self.waiting.exists() else None
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)

    def close(self) -> None:
        pass


def limits_stream(requests: DataFrame, cooldown: float, daily: int) -> DataFrame:
    """scope, id and verdict of a stream of scope (long), id (long), key (string), at (timestamp with a watermark) and starts.

    Needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass``."""
    rows = requests.withColumn("micros", F.unix_micros("at"))
    return rows.groupBy("scope").transformWithStateInPandas(_Judge(cooldown, daily), "scope long, id long, verdict string", "append", "eventTime")
