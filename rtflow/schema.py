"""Table schemas: the ``[{field_name, field_type}, ...]`` form and Spark's ``StructType``.

Column 0 of every stream table is ``event_time``, a TIMESTAMP.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

EVENT_TIME = "event_time"
WINDOW_START = "window_start"
WINDOW_END = "window_end"
TIME_COLUMNS = (EVENT_TIME, WINDOW_START, WINDOW_END)

#: Hidden column of windowed outputs: the Spark window struct the row was produced from.
#: It carries the watermark to the next job of a chain and is never written to a sink.
WINDOW = "__w"

# The names a table schema may use, and their Spark types.
FIELD_TYPES = {
    "INT": T.IntegerType(),
    "LONG": T.LongType(),
    "BIGINT": T.LongType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "TIMESTAMP": T.TimestampType(),
}

_NAMES = {
    T.IntegerType(): "INT",
    T.LongType(): "BIGINT",
    T.FloatType(): "FLOAT",
    T.DoubleType(): "DOUBLE",
    T.StringType(): "STRING",
    T.TimestampType(): "TIMESTAMP",
}

SchemaLike = str | Sequence[dict] | T.StructType


def to_struct(schema: SchemaLike) -> T.StructType:
    """Build a ``StructType`` from a schema given as JSON text or as a list of fields."""
    if isinstance(schema, T.StructType):
        return schema
    fields = json.loads(schema) if isinstance(schema, str) else schema
    struct = T.StructType()
    for field in fields:
        name, kind = field["field_name"], str(field["field_type"]).upper()
        if kind not in FIELD_TYPES:
            raise ValueError(f"column {name!r}: unknown type {kind!r}, use one of {sorted(FIELD_TYPES)}")
        if name in struct.fieldNames():
            raise ValueError(f"column {name!r} is declared twice")
        struct.add(name, FIELD_TYPES[kind])
    return struct


def to_fields(struct: T.StructType) -> list[dict]:
    """The inverse of :func:`to_struct`, for storing the schema of a job's output."""
    fields = []
    for field in struct.fields:
        if field.name == WINDOW:
            continue
        if field.dataType not in _NAMES:
            raise ValueError(f"column {field.name!r}: {field.dataType.simpleString()} has no table type")
        fields.append({"field_name": field.name, "field_type": _NAMES[field.dataType]})
    return fields


def check_stream_schema(struct: T.StructType) -> T.StructType:
    first = struct.fields[0] if struct.fields else None
    if first is None or first.name != EVENT_TIME or not isinstance(first.dataType, T.TimestampType):
        raise ValueError(f"the first column of a stream table must be {EVENT_TIME} TIMESTAMP")
    return struct


def cast_output(df: DataFrame, schema: SchemaLike) -> DataFrame:
    """Re-type a job output to its declared schema, column by column. Nulls stay null.

    A hidden window column is kept, so the result can still feed another job.
    """
    struct = to_struct(schema)
    missing = [name for name in struct.fieldNames() if name not in df.columns]
    if missing:
        raise ValueError(f"declared columns {missing} are not in the output {df.columns}")
    current = {field.name: field.dataType for field in df.schema.fields}
    # A column that has its type already is passed on as it is: a cast would drop its watermark.
    columns = [
        F.col(f"`{field.name}`")
        if current[field.name] == field.dataType
        else F.col(f"`{field.name}`").cast(field.dataType).alias(field.name)
        for field in struct.fields
    ]
    if WINDOW in df.columns:
        columns.append(F.col(WINDOW))
    return df.select(*columns)
