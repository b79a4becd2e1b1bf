"""Results against the inputs that they claim to evaluate: identity, coverage, evidence and provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_field, canonical_json, lines_of

#: Fixed value: what an input and its result must agree in; context and scope are JSON.
IDENTITY = ("schema_version", "repository_id", "scan_id", "commit_sha", "check_id", "detector_version", "context", "scope")


def same_identity(inputs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """key and the identity fields in which a result differs from its input, or ``no input`` where it has none.

    Values are compared in canonical form, so neither the order of keys nor spaces count; two nulls are equal."""
    form = lambda c: F.col(c).cast("string") if c not in ("context", "scope") else F.coalesce(canonical_json(F.col(c)), F.concat(F.lit("not JSON: "), F.col(c)))
    own = inputs.select(key, F.struct(*(form(c).alias(c) for c in IDENTITY)).alias("_input"))
    rows = results.select(key, F.struct(*(form(c).alias(c) for c in IDENTITY)).alias("_result")).join(own, key, "left")
    differs = F.filter(F.array(*(F.when(~F.col(f"_input.{c}").eqNullSafe(F.col(f"_result.{c}")), F.lit(c)) for c in IDENTITY)), lambda x: x.isNotNull())
    fields = F.when(F.col("_input").isNull(), F.array(F.lit("no input"))).otherwise(differs)
    return rows.select(key, F.array_join(fields, ",").alias("fields")).where("fields != ''")


def rejected_evidence(evidence: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Evidence that its source does not bear out, with the reason.

    evidence: key, n, source_id, scope_id, locator, kind, line (from 1), field, value; sources: key, source_id, scope_id,
    locator, kind, content (of static ones), data (a JSON object, of others). A static quote must equal the source's
    lines from its line on, and hold one at least; a value must equal the named field's in canonical form."""
    own = sources.select(key, "source_id", *(F.col(c).alias(f"_{c}") for c in ("scope_id", "locator", "kind", "content", "data")))
    rows = evidence.join(own, [key, "source_id"], "left")
    quote, lines = lines_of(F.col("value")), lines_of(F.col("_content"))
    there = F.slice(lines, F.greatest(F.col("line"), F.lit(1)), F.greatest(F.size(quote), F.lit(1)))
    value = canonical_field(F.col("_data"), F.col("field"))
    bad_quote = (F.size(quote) == 0) | (F.col("line") < 1) | (there != quote)
    bad_value = value.isNull() | (value != canonical_json(F.col("value")))
    steps: list[tuple[Column, str]] = [
        (F.col("_scope_id").isNull(), "unknown source"), (F.col("_scope_id") != F.col("scope_id"), "different scope"), ((F.col("_locator") != F.col("locator")) | (F.col("_kind") != F.col("kind")), "locator or kind"),
        ((F.col("kind") == "static") & F.coalesce(bad_quote, F.lit(True)), "source lines"), ((F.col("kind") != "static") & F.coalesce(bad_value, F.lit(True)), "data field"),
    ]
    reason = reduce(lambda c, step: c.when(*step) if c is not None else F.when(*step), steps, None)
    return rows.select(*evidence.columns, reason.alias("reason")).where("reason IS NOT NULL")


def unsupplied(evaluated: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Evaluated scopes (key, scope_id) for which the input supplied no source."""
    return evaluated.select(key, "scope_id").distinct().join(sources.select(key, "scope_id").distinct(), [key, "scope_id"], "left_anti")


def unproven(provenance: DataFrame, sources: DataFrame, evaluated: DataFrame, key: str) -> DataFrame:
    """Measurements (key, measurement, source_id) that cite an unknown source, or one whose scope was not evaluated."""
    own = sources.select(key, "source_id", "scope_id").distinct()
    done = evaluated.select(key, "scope_id", F.lit(True).alias("_done")).distinct()
    rows = provenance.join(own, [key, "source_id"], "left").join(done, [key, "scope_id"], "left")
    reason = F.when(F.col("scope_id").isNull(), "unknown source").when(F.col("_done").isNull(), "scope not evaluated")
    return rows.select(*provenance.columns, reason.alias("reason")).where("reason IS NOT NULL")
