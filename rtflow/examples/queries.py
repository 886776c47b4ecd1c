"""The flows as queries: ``(spark, sf_dir) -> DataFrame``, in batch or as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rtflow.examples import flows
from rtflow.operators import WindowSpec
from rtflow.plans import Job, build, load_jobs
from rtflow.schema import EVENT_TIME, to_struct
from rtflow.sources import decode_json, load, stream_files, with_event_time
from rtflow.streaming import (
    StaticTables,
    build_once,
    configure,
    encode_json,
    run_available,
    run_batch,
    scratch_dir,
    start_materialised,
)
from rtflow.table import FlowTable

Query = Callable[[SparkSession, str], DataFrame]


def _session(spark: SparkSession) -> None:
    # Zone-less table times are read as UTC; text times are compared in UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    configure(spark)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_event_time(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        # One file: a stream follows its directory.
        path, options = sf_dir, {"pathGlobFilter": "events.parquet"}
    else:
        options = {}
    return stream_files(spark, path, table.schema, "parquet", options, "ts")


def _tables(spark: SparkSession, sf_dir: str, config: list[dict], stream: bool) -> dict[str, FlowTable | DataFrame]:
    """The tables that the jobs read."""
    loaders = {
        "events": lambda: (event_stream if stream else events)(spark, sf_dir),
        "customer": lambda: FlowTable(spark.read.parquet(f"{sf_dir}/customer.parquet"), static=True),
        "orders": lambda: FlowTable(spark.read.parquet(f"{sf_dir}/orders.parquet"), static=True),
    }
    read = {name for job in config for name in job["input_table_list"]}
    return {name: load() for name, load in loaders.items() if name in read}


def comparable(df: DataFrame) -> DataFrame:
    """Zone-less timestamps and rounded doubles, to compare with results of another engine."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _flow(config: list[dict], stream: bool = False, **options) -> Query:
    """The output of the last job."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _session(spark)
        tables = _tables(spark, sf_dir, config, stream)
        result = build(spark, tables, load_jobs(spark, config), **options)[config[-1]["output_table"]]
        return comparable(run_available(result.df) if stream else result.output)

    return query


def stream_static_join_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream joined with a static table that all its micro-batches read once."""
    _session(spark)
    config = flows.static_join("inner")
    tables = _tables(spark, sf_dir, config, True)
    with StaticTables(spark, tables):
        return comparable(run_available(build(spark, tables, load_jobs(spark, config))[config[-1]["output_table"]].df))


def _union(outputs: dict[str, DataFrame]) -> DataFrame:
    """Outputs of several jobs in one table, told apart by the column ``job``."""
    result = None
    for name, df in outputs.items():
        df = df.withColumn("job", F.lit(name))
        result = df if result is None else result.unionByName(df, allowMissingColumns=True)
    return comparable(result)


def _dataflow(config: list[dict], names: list[str]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _session(spark)
        tables, jobs = _tables(spark, sf_dir, config, False), load_jobs(spark, config)
        outputs = build_once(spark, tables, jobs, scratch_dir(spark), names, null_fill="text")
        return _union({name: outputs[name].output for name in names})

    return query


def _dataflow_written(config: list[dict], names: list[str]) -> Query:
    """The same through written tables: each job runs once and reads what its parents wrote."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _session(spark)
        tables = _tables(spark, sf_dir, config, False)
        outputs = run_batch(spark, tables, load_jobs(spark, config), scratch_dir(spark), null_fill="text")
        return _union({name: outputs[name] for name in names})

    return query


def _dataflow_materialised(config: list[dict], names: list[str], written: str = "all") -> Query:
    """The same as streams, one query per job (or per table with several readers), that follow each other's tables."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _session(spark)
        root = scratch_dir(spark)
        tables = _tables(spark, sf_dir, config, True)
        start_materialised(spark, tables, load_jobs(spark, config), root, available_now=True, written=written)
        return _union({name: spark.read.parquet(f"{root}/tables/{name}") for name in names})

    return query


def tumble_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job given in parts instead of SQL text."""
    _session(spark)
    job = Job(
        output="sums",
        inputs=["events"],
        select=["event_type", ("sum(value)", "total"), "max(value) as top"],
        window=WindowSpec("tumble", size=3600),
        where="value > 5",
        group_by=["event_type"],
        having="sum(value) > 20",
    )
    return comparable(build(spark, {"events": events(spark, sf_dir)}, [job])["sums"].output)


def static_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static table as its declared schema says: ``select * from customer``."""
    spec = {
        "table_id": "customer",
        "table_type": "static",
        "schema": [
            {"field_name": "c_custkey", "field_type": "LONG"},
            {"field_name": "c_name", "field_type": "STRING"},
            {"field_name": "c_nationkey", "field_type": "INT"},
            {"field_name": "c_acctbal", "field_type": "DOUBLE"},
            {"field_name": "c_mktsegment", "field_type": "STRING"},
        ],
        "storages": {"files": {"path": f"{sf_dir}/customer.parquet", "format": "parquet"}},
    }
    _session(spark)
    return comparable(load(spark, spec))


def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON column of ``events``, decoded: ``k`` is there, the other fields are missing."""
    schema = [
        {"field_name": "k", "field_type": "INT"},
        {"field_name": "absent_number", "field_type": "BIGINT"},
        {"field_name": "absent_text", "field_type": "STRING"},
    ]
    _session(spark)
    return decode_json(spark.read.parquet(f"{sf_dir}/events.parquet"), schema, "props", keep=("event_id",))


def json_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    _session(spark)
    rows = events(spark, sf_dir).select(
        EVENT_TIME, "event_id", "user_id", F.nullif("event_type", F.lit("error")).alias("event_type"), "value", "props"
    )
    return encode_json(rows)


_EVENT_FIELDS = to_struct(
    [
        {"field_name": EVENT_TIME, "field_type": "TIMESTAMP"},
        {"field_name": "event_id", "field_type": "LONG"},
        {"field_name": "user_id", "field_type": "LONG"},
        {"field_name": "event_type", "field_type": "STRING"},
        {"field_name": "value", "field_type": "DOUBLE"},
        {"field_name": "props", "field_type": "STRING"},
    ]
)


def src_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a directory of JSON records, followed and decoded as a stream."""
    _session(spark)
    root = scratch_dir(spark)
    encode_json(events(spark, sf_dir)).write.text(f"{root}/topic")
    stream = stream_files(spark, f"{root}/topic", _EVENT_FIELDS, "json")
    return comparable(run_available(stream, f"{root}/run"))


def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's output as JSON records."""
    _session(spark)
    jobs = load_jobs(spark, flows.PROJECT_FILTER)
    result = build(spark, {"events": event_stream(spark, sf_dir)}, jobs)["picked"]
    return run_available(result.output, fmt="json")


#: The rows of ``late_drop`` arrive in three waves, told apart by this time and by their type.
SPLIT = "2024-01-16 00:00:00"
LATE_TYPE = "error"


def _late(config: list[dict]) -> Query:
    """Rows of one type arrive after the watermark has passed most of their windows.

    First come the events before ``SPLIT`` but for the late type, then those of the late type, then
    all others. Late rows count only in the windows that are still open.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _session(spark)
        root = scratch_dir(spark)
        rows = events(spark, sf_dir)
        early, late = F.col(EVENT_TIME) < F.lit(SPLIT).cast("timestamp"), F.col("event_type") == LATE_TYPE
        jobs = load_jobs(spark, config)
        result = None
        for wave in (early & ~late, early & late, ~early):
            rows.where(wave).write.mode("append").parquet(f"{root}/input")
            stream = stream_files(spark, f"{root}/input", rows.schema, "parquet")
            (output,) = build(spark, {"events": stream}, jobs).values()
            result = run_available(output.df, f"{root}/run")
        return comparable(result)

    return query


def queries() -> dict[str, Query]:
    batch = {
        "project_filter": _flow(flows.PROJECT_FILTER),
        "nowindow_time_cols": _flow(flows.NO_WINDOW),
        "scalar_passthrough": _flow(flows.SCALARS),
        "fn_time2str": _flow(flows.TIME_FUNCTIONS),
        "fn_utc2local": _flow(flows.TIME_FUNCTIONS, offset_hours=8),
        "cast_output": _flow([flows.CAST]),
        "static_scan": static_scan,
        "json_decode": json_decode,
        "json_encode": json_encode,
        "tumble_sum": _flow(flows.TUMBLE_SUM),
        "tumble_in_parts": tumble_in_parts,
        "tumble_count_all": _flow(flows.TUMBLE_COUNT),
        "tumble_other_aggs": _flow(flows.TUMBLE_OTHERS),
        "tumble_distinct": _flow(flows.TUMBLE_DISTINCT),
        "tumble_having": _flow(flows.TUMBLE_HAVING),
        "tumble_expression_key": _flow(flows.TUMBLE_EXPRESSION_KEY),
        "slide_max": _flow(flows.SLIDE_MAX),
        "slide_panes": _flow(flows.SLIDE_PANES),
        "slide_fine": _flow(flows.SLIDE_FINE),
        "slide_gap_max": _flow(flows.SLIDE_GAP_MAX),
        "session_count": _flow(flows.SESSION_COUNT),
        "session_small_keys": _flow(flows.SESSION_SMALL_KEYS),
        "session_other_aggs": _flow(flows.SESSION_OTHERS),
        "session_global": _flow(flows.SESSION_GLOBAL),
        "slide_having": _flow(flows.SLIDE_HAVING),
        "slide_decimal": _flow(flows.SLIDE_DECIMAL),
        "slide_avg_decimal": _flow(flows.SLIDE_AVG_DECIMAL),
        "slide_avg_wide": _flow(flows.SLIDE_AVG_WIDE),
        "session_avg_decimal": _flow(flows.SESSION_AVG_DECIMAL),
        "session_avg_wide": _flow(flows.SESSION_AVG_WIDE),
        "slide_moments": _flow(flows.SLIDE_MOMENTS),
        "session_moments": _flow(flows.SESSION_MOMENTS),
        "session_having": _flow(flows.SESSION_HAVING),
        "session_global_distinct": _flow(flows.SESSION_GLOBAL_DISTINCT),
        "ss_join_inner": _flow(flows.stream_join("inner")),
        "ss_join_left": _flow(flows.stream_join("left")),
        "ss_join_right": _flow(flows.stream_join("right")),
        "ss_join_salted": _flow(flows.stream_join("left"), join_salt=4),
        "ss_join_where": _flow(flows.stream_join("left", where="where a.value > 20 and b.event_id is null")),
        "ss_join_null_keys": _flow(flows.null_keys("left")),
        "ss_join_null_keys_right": _flow(flows.null_keys("right")),
        "static_join_null_keys": _flow(flows.static_null_keys("left")),
        "static_join_inner": _flow(flows.static_join("inner")),
        "static_join_left": _flow(flows.static_join("left")),
        "static_join_many": _flow(flows.STATIC_MANY),
        "join_null_fill": _flow(flows.static_join("left"), null_fill="text"),
        "ss_join_null_fill": _flow(flows.stream_join("right"), null_fill="text"),
        "chain_tumble_tumble": _flow(flows.CHAIN_TUMBLE_TUMBLE),
        "chain_tumble_slide_tumble": _flow(flows.CHAIN_TUMBLE_SLIDE_TUMBLE),
        "chain_join_tumble": _flow(flows.CHAIN_JOIN_TUMBLE),
        "chain_session_tumble": _flow(flows.CHAIN_SESSION_TUMBLE),
        "dataflow_01": _dataflow(flows.DATAFLOW_1, ["strong", "strong_samples", "strong_sums"]),
        "dataflow_02": _dataflow(flows.DATAFLOW_2, ["joined", "looked_up", "joined_tops"]),
        "dataflow_03": _dataflow(flows.DATAFLOW_3, ["kind_tops", "kind_counts"]),
        "dataflow_01_written": _dataflow_written(flows.DATAFLOW_1, ["strong", "strong_samples", "strong_sums"]),
    }
    streams = {
        "src_events_stream": src_events_stream,
        "sink_json": sink_json,
        "late_drop": _late(flows.TUMBLE_SUM),
        "late_slide": _late(flows.SLIDE_MAX),
        "late_slide_many": _late(flows.SLIDE_PANES),
        "stream_tumble_sum": _flow(flows.TUMBLE_SUM, stream=True),
        "stream_tumble_count_all": _flow(flows.TUMBLE_COUNT, stream=True),
        "stream_tumble_distinct": _flow(flows.TUMBLE_DISTINCT, stream=True),
        "stream_tumble_having": _flow(flows.TUMBLE_HAVING, stream=True),
        "stream_distinct_having": _flow(flows.DISTINCT_HAVING, stream=True),
        "stream_slide_having": _flow(flows.SLIDE_HAVING, stream=True),
        "stream_slide_max": _flow(flows.SLIDE_MAX, stream=True),
        "stream_slide_panes": _flow(flows.SLIDE_PANES, stream=True),
        "stream_slide_avg_wide": _flow(flows.SLIDE_AVG_WIDE, stream=True),
        "stream_session_avg_wide": _flow(flows.SESSION_AVG_WIDE, stream=True),
        "stream_slide_moments": _flow(flows.SLIDE_MOMENTS, stream=True),
        "stream_session_moments": _flow(flows.SESSION_MOMENTS, stream=True),
        "stream_slide_gap_max": _flow(flows.SLIDE_GAP_MAX, stream=True),
        "stream_session_count": _flow(flows.SESSION_COUNT, stream=True),
        "stream_session_global": _flow(flows.SESSION_GLOBAL, stream=True),
        "stream_join_inner": _flow(flows.stream_join("inner"), stream=True),
        "stream_join_left": _flow(flows.stream_join("left"), stream=True),
        "stream_join_right": _flow(flows.stream_join("right"), stream=True),
        "stream_join_salted": _flow(flows.stream_join("right"), stream=True, join_salt=4),
        "stream_join_null_keys": _flow(flows.null_keys("left"), stream=True),
        "stream_static_join_null_keys": _flow(flows.static_null_keys("left"), stream=True),
        "stream_static_join_inner": _flow(flows.static_join("inner"), stream=True),
        "stream_static_join_kept": stream_static_join_kept,
        "stream_static_join_left": _flow(flows.static_join("left"), stream=True, null_fill="text"),
        "stream_chain_tumble_tumble": _flow(flows.CHAIN_TUMBLE_TUMBLE, stream=True),
        "stream_chain_tumble_slide_tumble": _flow(flows.CHAIN_TUMBLE_SLIDE_TUMBLE, stream=True),
        "stream_chain_join_tumble": _flow(flows.CHAIN_JOIN_TUMBLE, stream=True),
        "stream_chain_session_tumble": _flow(flows.CHAIN_SESSION_TUMBLE, stream=True),
        "stream_dataflow_01_shared": _dataflow_materialised(flows.DATAFLOW_1, ["strong", "strong_samples", "strong_sums"], "shared"),
        "stream_dataflow_03_materialised": _dataflow_materialised(flows.DATAFLOW_3, ["kind_tops", "kind_counts"]),
    }
    return {**batch, **streams}
