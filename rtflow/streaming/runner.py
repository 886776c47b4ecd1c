"""Run data flows: as streams, one query per output, or as one batch."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from rtflow.functions.time import register_functions
from rtflow.plans.dataflow import apply_job, build, job_order, shared_tables
from rtflow.plans.jobs import Job
from rtflow.schema import WINDOW
from rtflow.sources.tables import WATERMARK_DELAY, stream_files
from rtflow.streaming.sinks import check_storages, fan_out, file_writer, storage_writer, store
from rtflow.table import FlowTable

#: Fixed value: how often a running flow looks for input and checkpoints.
TRIGGER = "1 second"

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: From an output's name and table to its writer, or ``None`` for an output without a sink.
SinkFactory = Callable[[str, DataFrame], DataStreamWriter | None]


def configure(spark: SparkSession, rocksdb: bool = True, state_partitions: int | None = None) -> None:
    """Session settings for flows, and for large streaming state above all.

    State is kept in RocksDB with changelog checkpoints rather than on the JVM heap, and session
    windows are merged within each map task first, so a hot key reaches its reducer as a few rows.
    The number of shuffle partitions stays as the session has it. A stream keeps the number it starts
    with, as it is the number of its state stores; ``state_partitions`` sets it, for the session.
    """
    if state_partitions is not None:
        if state_partitions < 1:
            raise ValueError("state_partitions must be at least 1")
        spark.conf.set("spark.sql.shuffle.partitions", state_partitions)
    if rocksdb:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


def scratch_dir(spark: SparkSession) -> str:
    """A new directory all executors can reach, for intermediate tables and checkpoints.

    It is deleted when the session's JVM ends. It lies in ``spark.checkpoint.dir``. Only a local-mode session, whose executors are this very
    machine, may go without that setting.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    path = f"{shared.rstrip('/')}/rtflow-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def run_available(
    df: DataFrame, directory: str | None = None, fmt: str = "parquet", offset_hours: int = 0
) -> DataFrame:
    """Run a stream over all input there is now, stop, and return what has been written.

    Windows that the watermark has not passed stay open: their rows are not in the result. Given
    the same ``directory`` again, the stream goes on from where it stopped.
    """
    spark = df.sparkSession
    root = directory or scratch_dir(spark)
    writer = file_writer(df, f"{root}/data", fmt, offset_hours)
    query = writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    reader = spark.read
    if fmt == "json":
        return reader.schema("value string").text(f"{root}/data")
    return reader.schema(df.drop(WINDOW).schema).format(fmt).load(f"{root}/data")


def start(
    outputs: Mapping[str, FlowTable], sink: SinkFactory, checkpoints: str, available_now: bool = False
) -> dict[str, StreamingQuery]:
    """Start one query per output table of a built flow (*fused* mode).

    Each query runs the whole chain above its output, so event time is handed on inside one query
    and nothing is written in between.
    """
    queries = {}
    for name, table in outputs.items():
        writer = sink(name, table.output)
        if writer is not None:
            writer = writer.queryName(name).option("checkpointLocation", f"{checkpoints}/{name}")
            queries[name] = _triggered(writer, available_now).start()
    return queries


def configured_sinks(jobs: Iterable[Job], options: Mapping | None = None, offset_hours: int = 0) -> SinkFactory:
    """Sinks as the jobs' ``storages`` say; ``options`` go to the Kafka writers."""
    storages = {job.output: job.storages for job in jobs}
    return lambda name, df: storage_writer(df, storages[name], options, offset_hours)


def _triggered(writer: DataStreamWriter, available_now: bool) -> DataStreamWriter:
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)


#: Which outputs are written for the jobs that read them: all, or those that several jobs read.
ALL, SHARED = "all", "shared"


def start_materialised(
    spark: SparkSession,
    tables: Mapping[str, FlowTable | DataFrame],
    jobs: Iterable[Job],
    directory: str,
    available_now: bool = False,
    null_fill: str = "sql",
    join_salt: int = 1,
    offset_hours: int = 0,
    delay: str = WATERMARK_DELAY,
    written: str = ALL,
    storages: bool = False,
    options: Mapping | None = None,
) -> dict[str, StreamingQuery]:
    """Start one query per output, each writing its table for the jobs that read it.

    Every job does its work once however many jobs read its output, and restarts the event time
    with a watermark of its own; a chain closes its windows one watermark delay later per job. With
    ``written="shared"`` that is so only where several jobs read an output, and chains of jobs run
    within the query of their last one, without a delay. Then only those outputs have a query that
    several jobs read, or none.

    Tables are parquet under ``<directory>/tables/<output>``. With ``storages`` each query also writes
    where its job's ``storages`` say: the same batch, once, to both; ``options`` go to Kafka. With
    ``available_now`` the jobs run one after the other, to the end of the input.
    """
    if written not in (ALL, SHARED):
        raise ValueError(f"written must be one of {(ALL, SHARED)}")
    register_functions(spark, offset_hours)
    known = {name: FlowTable.of(table) for name, table in tables.items()}
    order, options = job_order(jobs, known), options or {}
    read = {name for job in order for name in job.inputs}
    # A job's own storage is a reader, too.
    stored = [job.output for job in order if storages and job.storages]
    apart = {job.output for job in order} if written == ALL else shared_tables(order, stored)
    if storages:
        for job in order:
            check_storages(job.output, job.storages, options)
    queries = {}
    for job in order:
        result = apply_job(job, known, null_fill, join_salt, offset_hours)
        if job.output not in apart and job.output in read:
            known[job.output] = result
            continue
        path, checkpoint = f"{directory}/tables/{job.output}", f"{directory}/checkpoints/{job.output}"
        writer = fan_out(result.output, path, job.storages if storages else {}, options, checkpoint, offset_hours)
        queries[job.output] = _triggered(writer.queryName(job.output), available_now).start()
        if available_now:
            queries[job.output].awaitTermination()
        if job.output in read:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
            known[job.output] = FlowTable(stream_files(spark, path, result.output.schema, "parquet", delay=delay))
    return queries


def build_once(
    spark: SparkSession,
    tables: Mapping[str, FlowTable | DataFrame],
    jobs: Iterable[Job],
    directory: str,
    outputs: Iterable[str] | None = None,
    **how,
) -> dict[str, FlowTable]:
    """Compose a batch flow; tables with several readers are written to ``directory``, and read from there.

    A source is scanned once by each job that reads it, whatever reads that job. ``outputs`` are the tables
    that will be asked for (all, by default), ``how`` is passed on to :func:`rtflow.build`.
    """

    def once(name: str, table: FlowTable) -> FlowTable:
        if table.streaming:
            raise ValueError("run streams with start_materialised(written='shared')")
        path = f"{directory}/{name}"
        table.df.write.mode("errorifexists").parquet(path)
        return FlowTable(spark.read.schema(table.df.schema).parquet(path))

    return build(spark, tables, jobs, outputs=outputs, once=once, **how)


def run_batch(
    spark: SparkSession,
    tables: Mapping[str, FlowTable | DataFrame],
    jobs: Iterable[Job],
    directory: str,
    fmt: str = "parquet",
    null_fill: str = "sql",
    join_salt: int = 1,
    offset_hours: int = 0,
    storages: bool = False,
    options: Mapping | None = None,
) -> dict[str, DataFrame]:
    """Run a flow once over batch tables and write every output to ``<directory>/<output>``.

    A job that reads another's output reads what has been written, so no job is computed twice and
    a lost executor costs at most the job that is running. With ``storages`` what has been written is
    also added, once, to where the job's ``storages`` say; ``options`` go to Kafka.
    """
    register_functions(spark, offset_hours)
    known = {name: FlowTable.of(table) for name, table in tables.items()}
    order, options = job_order(jobs, known), options or {}
    if storages:
        for job in order:
            check_storages(job.output, job.storages, options)
    written = {}
    for job in order:
        result = apply_job(job, known, null_fill, join_salt, offset_hours).output
        path = f"{directory}/{job.output}"
        result.write.mode("errorifexists").format(fmt).save(path)
        written[job.output] = spark.read.schema(result.schema).format(fmt).load(path)
        known[job.output] = FlowTable(written[job.output])
        if storages:
            store(written[job.output], job.storages, options, path, "all", f"{directory}/_sent/{job.output}", offset_hours)
    return written
