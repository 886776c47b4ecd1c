"""Input tables: event streams from topics or file directories, and static tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rtflow.schema import EVENT_TIME, SchemaLike, check_stream_schema, to_struct
from rtflow.sources.codec import decode_json
from rtflow.table import FlowTable

#: Fixed value: how far out of order events may be before they are dropped.
WATERMARK_DELAY = "2 seconds"

STREAM = "stream"
STATIC = "static"


@dataclass(frozen=True)
class TableSpec:
    """Where a table lives and what it holds: one record of the table metadata."""

    table_id: str
    table_type: str
    schema: T.StructType
    storages: dict
    options: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, record: Mapping) -> "TableSpec":
        storages = record["storages"]
        spec = cls(
            table_id=record["table_id"],
            table_type=record["table_type"],
            schema=to_struct(record["schema"]),
            storages=json.loads(storages) if isinstance(storages, str) else dict(storages),
            options=dict(record.get("options") or {}),
        )
        if spec.table_type not in (STREAM, STATIC):
            raise ValueError(f"table {spec.table_id!r}: table_type must be 'stream' or 'static'")
        if spec.table_type == STREAM:
            check_stream_schema(spec.schema)
        return spec


def with_event_time(
    df: DataFrame, time_column: str = EVENT_TIME, delay: str = WATERMARK_DELAY, idle: str | None = None
) -> DataFrame:
    """Put the event time first, as ``event_time TIMESTAMP``, and set the watermark on it.

    A zone-less timestamp is read in the session time zone, as ``withWatermark`` needs an instant.
    On a batch DataFrame the watermark has no effect and Spark drops it.

    Spark's watermark is the least of all inputs', so a silent input holds back what it is joined with.
    With ``idle`` (an interval such as ``10 seconds``) a stream's watermark follows the clock at least
    that far behind, and the delay, whether or not events come. It is for inputs whose event times follow
    the clock: events older than ``idle`` and the delay are late, so a replay of the past needs none.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (time_column, EVENT_TIME)]
    timed = df.select(F.col(f"`{time_column}`").cast("timestamp").alias(EVENT_TIME), *rest)
    if idle is None or not df.isStreaming:
        return timed.withWatermark(EVENT_TIME, delay)
    # Heartbeats of one row a second pass the watermark and are left out above it. Spark pushes conditions
    # below a watermark, where they would take the heartbeats away, unless they depend on the event time:
    # so all columns do.
    clock = df.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    beats = clock.select((F.col("timestamp") - F.expr(f"INTERVAL {idle}")).alias(EVENT_TIME))
    known = timed.withColumn("__real", F.col(EVENT_TIME))
    both = known.unionByName(beats, allowMissingColumns=True).withWatermark(EVENT_TIME, delay)
    real = F.col("__real").eqNullSafe(F.col(EVENT_TIME))
    columns = [F.when(real, F.col(f"`{c}`")).alias(c) for c in timed.columns if c != EVENT_TIME]
    return both.where(real).select(EVENT_TIME, *columns)


def stream_topic(
    spark: SparkSession,
    topic: str,
    schema: SchemaLike,
    options: Mapping,
    delay: str = WATERMARK_DELAY,
    streaming: bool = True,
    idle: str | None = None,
) -> DataFrame:
    """Read JSON records of a Kafka topic, from the earliest offset unless ``options`` say otherwise.

    With ``streaming=False`` what the topic holds now is read as a batch.
    """
    struct = check_stream_schema(to_struct(schema))
    if "kafka.bootstrap.servers" not in options:
        raise ValueError(f"topic {topic!r}: option kafka.bootstrap.servers is missing")
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    records = reader.option("startingOffsets", "earliest").options(**options).option("subscribe", topic).load()
    return with_event_time(decode_json(records.select(F.col("value").cast("string")), struct), delay=delay, idle=idle)


def stream_files(
    spark: SparkSession,
    path: str,
    schema: SchemaLike,
    fmt: str = "json",
    options: Mapping | None = None,
    time_column: str = EVENT_TIME,
    delay: str = WATERMARK_DELAY,
    idle: str | None = None,
) -> DataFrame:
    """Follow a directory of files: ``json`` lines are decoded like topic records, other formats as typed.

    ``schema`` is the schema of the files. ``path`` must be a directory; use the option
    ``pathGlobFilter`` to pick files in it.
    """
    reader = spark.readStream.options(**(options or {}))
    if fmt == "json":
        df = decode_json(reader.format("text").load(path), schema)
    else:
        df = reader.format(fmt).schema(to_struct(schema)).load(path)
    return with_event_time(df, time_column, delay, idle)


def read_files(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: SchemaLike | None = None,
    options: Mapping | None = None,
) -> DataFrame:
    """Read a table from files, with the columns of ``schema`` if one is given."""
    reader = spark.read.options(**(options or {}))
    if fmt == "json" and schema is not None:
        return decode_json(reader.format("text").load(path), schema)
    if schema is not None and fmt not in ("parquet", "orc"):
        return reader.schema(to_struct(schema)).format(fmt).load(path)
    df = reader.format(fmt).load(path)
    return df if schema is None else _as_declared(df, to_struct(schema))


def read_jdbc(spark: SparkSession, table: str, schema: SchemaLike | None, options: Mapping) -> DataFrame:
    """``select * from table`` over JDBC.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``, or say with
    ``numPartitions`` 1 that one task may read the whole table. Filters are pushed to the database.
    """
    if "url" not in options:
        raise ValueError(f"static table {table!r}: JDBC option url is missing")
    named = {name.lower(): str(value) for name, value in options.items()}
    if "partitioncolumn" not in named and named.get("numpartitions") != "1":
        raise ValueError(
            f"static table {table!r}: pass partitionColumn, lowerBound, upperBound and numPartitions, "
            "or numPartitions=1 to read it in one task"
        )
    df = spark.read.format("jdbc").options(**options).option("dbtable", table).load()
    if schema is None:
        return df
    # As the columns come by position, the declared names replace the database's.
    struct = to_struct(schema)
    if len(df.columns) < len(struct.fields):
        raise ValueError(f"static table {table!r} has {len(df.columns)} columns, {len(struct.fields)} are declared")
    return _as_declared(df.select(*df.columns[: len(struct.fields)]).toDF(*struct.fieldNames()), struct)


def _as_declared(df: DataFrame, struct: T.StructType) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in struct.fields])


def load(
    spark: SparkSession,
    spec: TableSpec | Mapping,
    delay: str = WATERMARK_DELAY,
    streaming: bool = True,
    idle: str | None = None,
) -> DataFrame:
    """Load a table as its spec says.

    ``storages`` has one of ``{"kafka": {"topic": T}}`` for streams, ``{"mysql": {"table": T}}`` or
    ``{"jdbc": {"table": T}}`` for static tables, or ``{"files": {"path": P, "format": F}}`` for
    either. With ``streaming=False`` a stream is read once, as a batch. ``idle`` is as in
    :func:`with_event_time`.
    """
    spec = spec if isinstance(spec, TableSpec) else TableSpec.from_dict(spec)
    files = spec.storages.get("files")
    if spec.table_type == STATIC:
        database = spec.storages.get("mysql") or spec.storages.get("jdbc")
        if database:
            return read_jdbc(spark, database["table"], spec.schema, spec.options)
        if files:
            return read_files(spark, files["path"], files.get("format", "parquet"), spec.schema, spec.options)
    elif files:
        fmt = files.get("format", "json")
        if streaming:
            return stream_files(spark, files["path"], spec.schema, fmt, spec.options, delay=delay, idle=idle)
        return with_event_time(read_files(spark, files["path"], fmt, spec.schema, spec.options), delay=delay)
    elif "kafka" in spec.storages:
        topic = spec.storages["kafka"]["topic"]
        return stream_topic(spark, topic, spec.schema, spec.options, delay, streaming, idle)
    raise ValueError(f"table {spec.table_id!r}: no usable storage in {sorted(spec.storages)} for a {spec.table_type} table")


def load_tables(
    spark: SparkSession,
    specs: Iterable[TableSpec | Mapping],
    delay: str = WATERMARK_DELAY,
    streaming: bool = True,
    idle: str | None = None,
) -> dict[str, FlowTable]:
    """Load every table once, by its id."""
    tables: dict[str, FlowTable] = {}
    for record in specs:
        spec = record if isinstance(record, TableSpec) else TableSpec.from_dict(record)
        if spec.table_id in tables:
            raise ValueError(f"table {spec.table_id!r} is declared twice")
        tables[spec.table_id] = FlowTable(load(spark, spec, delay, streaming, idle), static=spec.table_type == STATIC)
    return tables
