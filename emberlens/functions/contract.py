"""Identity and canonical form of findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(*parts: Column) -> Column:
    """Compact JSON of an array of strings."""
    return F.to_json(F.array(*parts))


def fingerprint(repository: Column, check: Column, scope: Column, identity: Column) -> Column:
    """Stable name of a finding: no line numbers, values or commits go in."""
    return F.sha2(canonical(repository, check, scope, identity), 256)


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 0).when(confidence == "medium", 1).when(confidence == "low", 2).otherwise(3)


def status(evaluable: Column, hit: Column) -> Column:
    """Three states: too little evidence is never clean."""
    return F.when(~F.coalesce(evaluable, F.lit(False)), "omitted").when(F.coalesce(hit, F.lit(False)), "detected").otherwise("clean")


def suffixed(anchor: Column, ordinal: Column) -> Column:
    """anchor, anchor#2, anchor#3 for repeated anchors in line order."""
    return F.when(ordinal > 1, F.concat(anchor, F.lit("#"), ordinal.cast("string"))).otherwise(anchor)
