"""Schedules as instants: rate expressions and five-field or six-field cron in a time zone, within a horizon."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names in cron fields.
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
DAYS = "SUN MON TUE WED THU FRI SAT".split()
UNITS = {"minute": 60, "hour": 3600, "day": 86400}


def _values(field: str, low: int, high: int, names: dict[str, int]) -> set[int]:
    out: set[int] = set()
    for part in field.upper().split(","):
        body, _, step = part.partition("/")
        if body in ("*", "?"):
            first, last = low, high
        else:
            ends = [names[e] if e in names else int(e) for e in body.split("-")]
            first, last = ends[0], ends[-1] if len(ends) > 1 or not step else high
        if not low <= first <= last <= high:
            raise ValueError(field)
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def cron_times(expression: str, dialect: str, zone: str, start: dt.datetime, end: dt.datetime) -> list[dt.datetime]:
    """Instants in [start, end). Local times that a clock change skips don't occur; those that it repeats occur once."""
    fields = expression.split()
    aws = dialect == "aws"
    if len(fields) != (6 if aws else 5):
        raise ValueError(expression)
    minute, hour, day, month, weekday = fields[:5]
    minutes, hours = _values(minute, 0, 59, {}), _values(hour, 0, 23, {})
    days, months = _values(day, 1, 31, {}), _values(month, 1, 12, {n: i + 1 for i, n in enumerate(MONTHS)})
    names = {n: i + aws for i, n in enumerate(DAYS)}
    weekdays = {(d - aws) % 7 for d in _values(weekday, int(aws), 7, names)}
    years = _values(fields[5], 1970, 2199, {}) if aws else None
    free_day, free_weekday = day in ("*", "?"), weekday in ("*", "?")
    tz, out = ZoneInfo(zone), []
    date, last = start.astimezone(tz).date(), end.astimezone(tz).date()
    while date <= last:
        in_day, in_week = date.day in days, (date.weekday() + 1) % 7 in weekdays
        fits = (in_day or in_week) if not (free_day or free_weekday) else in_day and in_week
        if fits and date.month in months and (years is None or date.year in years):
            for h in sorted(hours):
                for m in sorted(minutes):
                    local = dt.datetime(date.year, date.month, date.day, h, m, tzinfo=tz)
                    instant = local.astimezone(dt.UTC)
                    if instant.astimezone(tz).replace(tzinfo=None) == local.replace(tzinfo=None) and start <= instant < end:
                        out.append(instant)
        date += dt.timedelta(days=1)
    return out


def occurrences(schedules: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """job_id, at and problem for ``schedules`` (job_id, expression, dialect, timezone); a malformed one gives one row with its problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            jobs, times, problems = [], [], []
            for job, expression, dialect, zone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rate = re.fullmatch(r"rate\((\d+) (minute|hour|day)s?\)", expression or "")
                    inner = re.fullmatch(r"cron\((.*)\)", expression or "")
                    if rate:
                        step = dt.timedelta(seconds=int(rate[1]) * UNITS[rate[2]])
                        if not step:
                            raise ValueError("a rate of zero")
                        found = [start + k * step for k in range(-(-(end - start) // step))]
                    else:
                        found = cron_times(inner[1] if inner else expression, "aws" if inner else dialect or "posix", zone or "UTC", start, end)
                    rows = [(t, None) for t in found]
                except Exception as e:  # one schedule's fault is its own row
                    rows = [(None, f"{type(e).__name__}: {e}")]
                jobs += [job] * len(rows)
                times += [r[0] for r in rows]
                problems += [r[1] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(jobs, pa.string()), pa.array(times, pa.timestamp("us", "UTC")), pa.array(problems, pa.string())], names=["job_id", "at", "problem"])

    columns = [F.col(c).cast("string") for c in ("job_id", "expression", "dialect", "timezone")]
    return schedules.select(*columns).mapInArrow(run, "job_id string, at timestamp, problem string")
