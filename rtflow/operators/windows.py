"""Tumbling, sliding and session window aggregation on event time.

The event time of a windowed output is the end of its window, and the next job of a chain windows
on that. How rows get their windows differs between batch and stream, the results do not: see
``batch_windows`` and ``stream_windows``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import functions as F

from rtflow.functions.aggregates import split_aggregates
from rtflow.operators import batch_windows, stream_windows
from rtflow.operators.grouping import Grouping
from rtflow.operators.projection import Item, plain_column, select_items, time_columns
from rtflow.schema import WINDOW
from rtflow.table import FlowTable

NONE, TUMBLE, SLIDE, SESSION = "none", "tumble", "slide", "session"
_KINDS = (NONE, TUMBLE, SLIDE, SESSION)


@dataclass(frozen=True)
class WindowSpec:
    """A window type with its sizes in whole seconds. ``slide`` may be larger than ``size``."""

    kind: str = NONE
    size: int | None = None
    slide: int | None = None
    gap: int | None = None

    def __post_init__(self):
        if self.kind not in _KINDS:
            raise ValueError(f"unknown window type {self.kind!r}, use one of {_KINDS}")
        needed = {NONE: (), TUMBLE: ("size",), SLIDE: ("size", "slide"), SESSION: ("gap",)}[self.kind]
        for name in needed:
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or value < 1:
                raise ValueError(f"a {self.kind} window needs {name} in whole seconds, at least 1; got {value!r}")

    @property
    def step(self) -> int:
        """Seconds from the start of one window to the start of the next."""
        return self.slide if self.kind == SLIDE else self.size

    @property
    def gapped(self) -> bool:
        """Windows are shorter than their distance: rows between them are in no window."""
        return self.kind == SLIDE and self.slide > self.size

    @property
    def overlapping(self) -> bool:
        return self.kind == SLIDE and self.slide < self.size


def _same(a: str, b: str) -> bool:
    left, right = plain_column(a), plain_column(b)
    if left and right:
        return [x and x.lower() for x in left] == [x and x.lower() for x in right]
    return a.strip() == b.strip()


def window_aggregate(
    table: FlowTable,
    window: WindowSpec,
    select: Iterable[str | Item],
    group_by: Sequence[str] = (),
    where: str | None = None,
    having: str | None = None,
    offset_hours: int = 0,
) -> FlowTable:
    """``SELECT ... FROM table WHERE ... GROUP BY <window>, keys HAVING ...``.

    Aggregates may be any of Spark's. The output begins with the three time columns.
    """
    if window.kind == NONE:
        raise ValueError("an aggregation needs a window")
    items = select_items(select)
    keys = [f"__k{i}" for i in range(len(group_by))]
    key_of = {
        name: key for expression, name in items for key, group in zip(keys, group_by) if _same(expression, group)
    }
    aggregates = [(expression, name) for expression, name in items if name not in key_of]
    df = table.df.where(where) if where else table.df
    grouping = Grouping(
        keys=dict(zip(keys, group_by)),
        aggregates=aggregates,
        having=having,
        split=split_aggregates(df, aggregates, having, list(zip(group_by, keys))),
    )

    if df.isStreaming:
        grouped, start, end = stream_windows.aggregate(df, table.depth, window, grouping)
    else:
        grouped, start, end = batch_windows.aggregate(df, window, grouping)
    columns = [F.col(key_of.get(name, f"`{name}`")).alias(name) for _, name in items]
    hidden = [F.col(WINDOW)] if df.isStreaming else []
    result = grouped.select(*time_columns(end, start, end, offset_hours), *columns, *hidden)
    return FlowTable(result, depth=table.depth + 1 if df.isStreaming else 0)
