"""JSON text to typed columns, leniently, with Spark's built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rtflow.schema import SchemaLike, to_struct

_BROKEN = "__broken"


def _number(text: Column, kind: T.DataType) -> Column:
    """A number given as JSON number, text or boolean. Missing is 0, unreadable is null."""
    trimmed = F.trim(text)
    value = F.when(F.lower(trimmed) == "true", F.lit(1)).when(F.lower(trimmed) == "false", F.lit(0)).cast(kind)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        # A fraction is cut off; the whole-number reading comes first, so that large longs stay exact.
        value = F.coalesce(trimmed.try_cast(kind), trimmed.try_cast("double").try_cast(kind), value)
    else:
        value = F.coalesce(trimmed.try_cast(kind), value)
    return F.when(text.isNull() | F.lower(trimmed).isin("", "null"), F.lit(0).cast(kind)).otherwise(value)


def _timestamp(text: Column) -> Column:
    """A timestamp given as text in the session time zone or as epoch milliseconds."""
    trimmed = F.trim(text)
    millis = F.timestamp_millis(trimmed.try_cast("bigint"))
    return F.when(trimmed.rlike("^-?[0-9]+$"), millis).otherwise(F.try_to_timestamp(trimmed))


def _typed(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return _timestamp(text)
    if isinstance(kind, T.StringType):
        return text
    return _number(text, kind)


def decode_json(df: DataFrame, schema: SchemaLike, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Turn a column of JSON objects into the typed columns of ``schema``.

    Fields are matched by name, in any order; fields outside the schema are ignored. A missing
    number becomes 0 and a missing text null. A record that is not a JSON object gives a row of
    nulls. ``keep`` names further input columns to carry along, after the decoded ones.
    """
    struct = to_struct(schema)
    # Everything is read as text first: a typed from_json turns "7" into null for an INT.
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in struct.fields])
    as_text.add(_BROKEN, T.StringType())
    parsed = F.from_json(F.col(column), as_text, {"columnNameOfCorruptRecord": _BROKEN})
    rows = df.select(parsed.alias("__j"), *[F.col(name) for name in keep])
    broken = F.col("__j").isNull() | F.col(f"__j.{_BROKEN}").isNotNull()
    return rows.select(
        *[
            F.when(~broken, _typed(F.col(f"__j.`{field.name}`"), field.dataType)).alias(field.name)
            for field in struct.fields
        ],
        *[F.col(name) for name in keep],
    )
