"""The tables a data flow passes from job to job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

from rtflow.schema import EVENT_TIME, WINDOW, check_stream_schema


@dataclass(frozen=True)
class FlowTable:
    """A DataFrame with what the next job has to know about it.

    ``depth`` counts the windowed jobs a *streaming* table has passed through since its event time
    last carried a watermark of its own. Such a table has the hidden window column, and Spark's
    ``window_time`` of it is ``depth`` microseconds before the true event time; see
    ``operators.windows``. In batch the true ``event_time`` is windowed and ``depth`` stays 0.
    """

    df: DataFrame
    static: bool = False
    depth: int = 0

    def __post_init__(self):
        if not self.static:
            check_stream_schema(self.df.schema)
        elif self.df.isStreaming:
            raise ValueError("a static table cannot be a streaming DataFrame")

    @classmethod
    def of(cls, table: "FlowTable | DataFrame") -> "FlowTable":
        """A DataFrame that starts with ``event_time TIMESTAMP`` is a stream, any other is static."""
        if isinstance(table, FlowTable):
            return table
        first = table.schema.fields[0]
        static = first.name != EVENT_TIME or not isinstance(first.dataType, T.TimestampType)
        return cls(table, static=static)

    @property
    def streaming(self) -> bool:
        return self.df.isStreaming

    @property
    def output(self) -> DataFrame:
        """The table without its hidden column, as sinks and users see it."""
        return self.df.drop(WINDOW) if WINDOW in self.df.columns else self.df
