"""Canonical JSON of nested values, and lines as the evidence contract counts them."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

#: Fixed value: what ends a line, as Python's ``str.splitlines`` has it.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def canonical_text(text: str | None) -> str | None:
    """Compact JSON with sorted keys; null for what is no JSON, or holds a number that is not finite, or a lone surrogate.

    Of equal keys of an object the last counts."""
    if text is None:
        return None

    def refuse(name: str) -> float:
        raise ValueError(name)

    try:
        value = json.loads(text, parse_constant=refuse)
        out = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
        out.encode()
    except (ValueError, RecursionError):
        return None
    return out


def canonical_json(text: Column) -> Column:
    """``canonical_text`` over Arrow batches: values of any depth, and numbers as they are written everywhere else in the contract."""

    @arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(map(canonical_text, column.to_pylist()), pa.string())

    return run(text)


def canonical_field(data: Column, field: Column) -> Column:
    """Canonical JSON of one field of an object; null where the text is no JSON object or lacks the field."""

    @arrow_udf("string")
    def run(objects: pa.Array, fields: pa.Array) -> pa.Array:
        out = []
        for text, name in zip(objects.to_pylist(), fields.to_pylist(), strict=True):
            whole = canonical_text(text)
            value = json.loads(whole) if whole is not None else None
            out.append(canonical_text(json.dumps(value[name])) if isinstance(value, dict) and name in value else None)
        return pa.array(out, pa.string())

    return run(data, field)


def lines_of(text: Column) -> Column:
    """The lines of a text without their ends; an end at the very end begins no other line, and an empty text has none."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
