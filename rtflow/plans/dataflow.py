"""Compose the jobs of a data flow into DataFrames."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from rtflow.functions.time import register_functions
from rtflow.operators.joins import join_static, join_windowed
from rtflow.operators.projection import project
from rtflow.operators.windows import NONE, TUMBLE, window_aggregate
from rtflow.plans.jobs import Job
from rtflow.schema import cast_output
from rtflow.table import FlowTable


def job_order(jobs: Iterable[Job], tables: Iterable[str]) -> list[Job]:
    """The jobs in an order that puts each after the jobs it reads from."""
    by_output: dict[str, Job] = {}
    tables = set(tables)
    for job in jobs:
        if job.output in by_output:
            raise ValueError(f"two jobs write table {job.output!r}")
        if job.output in tables:
            raise ValueError(f"job output {job.output!r} is the name of an input table")
        by_output[job.output] = job
    for job in by_output.values():
        for name in job.inputs:
            if name not in by_output and name not in tables:
                raise ValueError(f"job {job.output!r} reads unknown table {name!r}")
    graph = {name: [i for i in job.inputs if i in by_output] for name, job in by_output.items()}
    try:
        return [by_output[name] for name in TopologicalSorter(graph).static_order()]
    except CycleError as error:
        raise ValueError(f"the jobs form a cycle: {' -> '.join(error.args[1])}") from error


def shared_tables(order: Sequence[Job], outputs: Iterable[str] | None = None) -> set[str]:
    """The tables that have several readers: jobs, and whoever asks for the ``outputs`` (by default all)."""
    written = [job.output for job in order]
    wanted = set(written if outputs is None else outputs)
    if unknown := wanted.difference(written):
        raise ValueError(f"no job writes {sorted(unknown)}")
    readers = Counter(name for job in order for name in set(job.inputs))
    return {name for name in written if readers[name] + (name in wanted) > 1 and readers[name]}


def apply_job(
    job: Job, tables: Mapping[str, FlowTable], null_fill: str = "sql", join_salt: int = 1, offset_hours: int = 0
) -> FlowTable:
    """The output of one job, given its input tables."""
    if job.join is None:
        table = tables[job.inputs[0]]
        if table.static:
            raise ValueError(f"job {job.output!r}: static table {job.inputs[0]!r} can only be joined to a stream")
        table = FlowTable(table.df.alias(job.alias or job.inputs[0]), depth=table.depth)
        if job.window.kind == NONE:
            result = project(table, job.select, job.where, offset_hours)
        else:
            result = window_aggregate(
                table, job.window, job.select, job.group_by, job.where, job.having, offset_hours
            )
    else:
        left, right = tables[job.join.left], tables[job.join.right]
        if left.static:
            raise ValueError(f"job {job.output!r}: static table {job.join.left!r} must be the right side of the join")
        if right.static:
            if job.window.kind != NONE:
                raise ValueError(f"job {job.output!r}: a join with a static table takes no window")
            result = join_static(
                left, right, job.join, job.select, job.where, null_fill, join_salt, offset_hours
            )
        else:
            if job.window.kind != TUMBLE:
                raise ValueError(f"job {job.output!r}: two streams are joined in a tumbling window")
            result = join_windowed(
                left, right, job.join, job.select, job.window.size, job.where, null_fill, join_salt, offset_hours
            )
    if job.schema is not None:
        result = FlowTable(cast_output(result.df, job.schema), depth=result.depth)
    return result


def build(
    spark: SparkSession,
    tables: Mapping[str, FlowTable | DataFrame],
    jobs: Iterable[Job],
    null_fill: str = "sql",
    join_salt: int = 1,
    offset_hours: int = 0,
    outputs: Iterable[str] | None = None,
    once: Callable[[str, FlowTable], FlowTable] | None = None,
) -> dict[str, FlowTable]:
    """Compose all jobs over the input tables. Nothing runs; the outputs come by table name.

    The same jobs work on batch and on streaming tables. ``null_fill="text"`` writes the text
    ``NULL`` and the number 0 where an outer join found no match, instead of nulls.

    A composed table is computed anew by each of its readers. ``once`` is called with every table that
    has several, as :func:`shared_tables` finds them, and returns what they read instead of it;
    ``rtflow.streaming.build_once`` writes such tables in batch.
    """
    register_functions(spark, offset_hours)
    known = {name: FlowTable.of(table) for name, table in tables.items()}
    order = job_order(jobs, known)
    shared = shared_tables(order, outputs) if once else set()
    for job in order:
        result = apply_job(job, known, null_fill, join_salt, offset_hours)
        known[job.output] = once(job.output, result) if job.output in shared else result
    return {job.output: known[job.output] for job in order}
