"""Typed rows and a quarantine for rows that do not parse.

Which rows survive is decided by a named list of required columns, never by
which columns a later query happens to read. Two routes:

- ``accept_rows`` / ``reject_rows`` straight from text, for one list;
- ``parse_typed`` once, keeping the text of malformed fields beside the typed
  row, then ``population`` / ``quarantine`` for each model's own list.
"""

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from ..functions.columns import is_malformed, typed
from .logs import CORRUPT

REASON = "bad_columns"
BAD_VALUES = "bad_values"


def landed_schema(schema: StructType) -> StructType:
    """``schema`` as ``parse_typed`` writes it."""
    bad = StructField(BAD_VALUES, MapType(StringType(), StringType()), True)
    return StructType([*schema.fields, bad])


def _checks(df: DataFrame, schema: StructType, columns: Sequence[str]) -> dict[str, Column]:
    checks = {
        c: is_malformed(F.col(c), schema[c].dataType)
        for c in columns
        if not isinstance(schema[c].dataType, StringType)
    }
    if CORRUPT in df.columns:
        checks[CORRUPT] = F.col(CORRUPT).isNotNull()
    return checks


def _any(checks: dict[str, Column]) -> Column:
    return reduce(or_, checks.values(), F.lit(False))


def typed_columns(df: DataFrame, schema: StructType, *extra: str | Column) -> DataFrame:
    """Project to ``schema``; malformed fields become null."""
    return df.select(
        *[typed(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields], *extra
    )


def accept_rows(
    df: DataFrame, schema: StructType, required: Sequence[str] | None = None
) -> DataFrame:
    """Rows whose required fields all parse (default: every field of ``schema``)."""
    checks = _checks(df, schema, schema.names if required is None else required)
    return typed_columns(df.where(~_any(checks)), schema)


def reject_rows(
    df: DataFrame, schema: StructType, required: Sequence[str] | None = None
) -> DataFrame:
    """The rows ``accept_rows`` leaves out, as text, with the names of their bad columns."""
    checks = _checks(df, schema, schema.names if required is None else required)
    reasons = [F.when(check, F.lit(name)) for name, check in checks.items()]
    return df.where(_any(checks)).select(
        *schema.names, F.concat_ws(",", *reasons).alias(REASON)
    )


def parse_typed(df: DataFrame, schema: StructType) -> DataFrame:
    """Every row typed, with a map of its malformed fields' text (null where there is none)."""
    checks = _checks(df, schema, schema.names)
    entries = [
        F.when(check, F.struct(F.lit(name).alias("key"), F.col(name).cast("string").alias("value")))
        for name, check in checks.items()
    ]
    bad = F.when(_any(checks), F.map_from_entries(F.array_compact(F.array(*entries))))
    return typed_columns(df, schema, bad.alias(BAD_VALUES))


def _touches(required: Sequence[str]) -> Column:
    names = F.array(*[F.lit(c) for c in (*required, CORRUPT)])
    return F.coalesce(F.arrays_overlap(F.map_keys(BAD_VALUES), names), F.lit(False))


def population(parsed: DataFrame, required: Sequence[str]) -> DataFrame:
    """Parsed rows without a malformed required field."""
    return parsed.where(F.col(BAD_VALUES).isNull() | ~_touches(required)).drop(BAD_VALUES)


def quarantine(parsed: DataFrame, required: Sequence[str]) -> DataFrame:
    """Parsed rows with a malformed required field, and the text of it."""
    return parsed.where(F.col(BAD_VALUES).isNotNull() & _touches(required))
