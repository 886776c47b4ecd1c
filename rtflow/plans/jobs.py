"""What one job of a data flow is, and how it is read from its configuration."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession, types as T

from rtflow.operators.joins import JoinSpec
from rtflow.operators.projection import Item, select_items
from rtflow.operators.windows import NONE, SESSION, SLIDE, WindowSpec
from rtflow.plans.sqltext import parse_select
from rtflow.schema import to_struct


@dataclass(frozen=True)
class Job:
    """Input tables, a window, a SELECT in parts, and the name of the output table."""

    output: str
    inputs: Sequence[str]
    select: Sequence[str | Item]
    window: WindowSpec = field(default_factory=WindowSpec)
    where: str | None = None
    group_by: Sequence[str] = ()
    having: str | None = None
    join: JoinSpec | None = None
    #: what the columns of a single input may be qualified with
    alias: str | None = None
    #: declared output schema; by default the output is as Spark infers it
    schema: T.StructType | None = None
    #: where a stream writes the output, as in a table spec; a topic of its name unless told otherwise
    storages: Mapping | None = None
    name: str = ""

    def __post_init__(self):
        def fail(text: str):
            raise ValueError(f"job {self.output!r}: {text}")

        object.__setattr__(self, "inputs", tuple(self.inputs))
        object.__setattr__(self, "group_by", tuple(self.group_by))
        try:
            object.__setattr__(self, "select", tuple(select_items(self.select)))
        except ValueError as error:
            fail(str(error))
        if not self.output:
            fail("it needs an output table")
        if self.storages is None:
            object.__setattr__(self, "storages", {"kafka": {"topic": self.output}})
        if not 1 <= len(self.inputs) <= 2:
            fail("it takes one input table, or two to join")
        if self.output in self.inputs:
            fail("its output is its own input")
        if self.window.kind == NONE and (self.group_by or self.having):
            fail("GROUP BY and HAVING need a window")
        if self.join is None:
            if len(self.inputs) != 1:
                fail("two input tables need a join")
            return
        if {self.join.left, self.join.right} != set(self.inputs):
            fail(f"it joins {self.join.left!r} and {self.join.right!r}, its inputs are {list(self.inputs)}")
        if self.group_by or self.having:
            fail("a join cannot be grouped: aggregate its output in another job")
        if self.window.kind in (SLIDE, SESSION):
            fail("streams are joined in tumbling windows only")

    @classmethod
    def from_config(cls, spark: SparkSession, record: Mapping) -> "Job":
        """Read a job record, ``{name, input_table_list, output_table, process_config}``.

        ``process_config`` has ``window_type``, ``window_size``, ``slide_size``, ``session_gap``
        and ``sql``. A record may add ``schema``, the declared schema of its output, and ``storages``,
        where a stream writes it.
        """
        config = record["process_config"]
        output = record.get("output_table") or ""
        kind = config.get("window_type") or NONE
        try:
            window = WindowSpec(
                kind,
                config.get("window_size"),
                config.get("slide_size"),
                config.get("session_gap"),
            )
            statement = parse_select(spark, config.get("sql") or "")
        except ValueError as error:
            raise ValueError(f"job {output!r}: {error}") from error
        inputs = list(record["input_table_list"])
        named = [statement.join.left, statement.join.right] if statement.join else [statement.table]
        # A self-join names one table twice and may list it once.
        if set(named) != set(inputs):
            raise ValueError(f"job {output!r}: the SQL reads {named}, the input list is {inputs}")
        return cls(
            output=output,
            inputs=named,
            select=statement.select,
            window=window,
            where=statement.where,
            group_by=statement.group_by,
            having=statement.having,
            join=statement.join,
            alias=statement.alias,
            schema=to_struct(record["schema"]) if record.get("schema") else None,
            storages=record.get("storages"),
            name=record.get("name", ""),
        )


def load_jobs(spark: SparkSession, config: str | Path | Mapping | Sequence[Mapping]) -> list[Job]:
    """Read jobs from a JSON file, or from its parsed content: one record or a list of them."""
    if isinstance(config, (str, Path)):
        config = json.loads(Path(config).read_text(encoding="utf-8"))
    records = [config] if isinstance(config, Mapping) else config
    return [Job.from_config(spark, record) for record in records]
