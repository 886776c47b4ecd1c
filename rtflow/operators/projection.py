"""Row-by-row jobs, and the select lists and time columns all operators share."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from rtflow.functions.time import time2str
from rtflow.schema import EVENT_TIME, TIME_COLUMNS, WINDOW, WINDOW_END, WINDOW_START
from rtflow.table import FlowTable

_COLUMN = re.compile(r"\s*(?:(`[^`]+`|\w+)\s*\.\s*)?(`[^`]+`|[^\W\d]\w*)\s*")
_ALIASED = re.compile(r"(.*\S)\s+as\s+(`[^`]+`|\w+)\s*", re.IGNORECASE | re.DOTALL)

Item = tuple[str, str]


def plain_column(expression: str) -> tuple[str | None, str] | None:
    """``(qualifier, name)`` if the expression is nothing but a column, else ``None``."""
    match = _COLUMN.fullmatch(expression)
    if match is None:
        return None
    return (match[1].strip("`") if match[1] else None, match[2].strip("`"))


def select_items(select: Iterable[str | Item]) -> list[Item]:
    """Normalise a select list to ``(expression, output name)`` pairs.

    An item is such a pair, a plain column, or text ending in ``AS name``.
    """
    items: list[Item] = []
    for item in select:
        if isinstance(item, str):
            aliased = _ALIASED.fullmatch(item)
            column = plain_column(item)
            if aliased is not None:
                item = (aliased[1], aliased[2].strip("`"))
            elif column is not None:
                item = (item.strip(), column[1])
            elif item.strip().endswith("*"):
                raise ValueError("SELECT * is not supported: name the columns")
            else:
                raise ValueError(f"select item {item!r} needs an alias")
        items.append((item[0], item[1]))
    names = [name.lower() for _, name in items]
    for name in names:
        if name in TIME_COLUMNS:
            raise ValueError(f"column {name!r} is added to every output and cannot be selected or used as an alias")
        if name.startswith("__"):
            raise ValueError(f"output column {name!r}: names beginning with two underscores are reserved")
        if names.count(name) > 1:
            raise ValueError(f"ambiguous output column {name!r}: give one of them another alias")
    if not items:
        raise ValueError("the select list is empty")
    return items


def time_columns(event_time: Column, start: Column, end: Column, offset_hours: int = 0) -> list[Column]:
    """The three columns every output begins with. The bounds are text, ``event_time`` is an instant."""
    return [
        event_time.alias(EVENT_TIME),
        time2str(start, offset_hours).alias(WINDOW_START),
        time2str(end, offset_hours).alias(WINDOW_END),
    ]


def row_time_columns(offset_hours: int = 0) -> list[Column]:
    """The time columns of a job without a window: both bounds are the event time."""
    now = F.col(EVENT_TIME)
    # event_time is passed on as it is, so that it keeps its watermark
    return [now, *time_columns(now, now, now, offset_hours)[1:]]


def project(table: FlowTable, select: Iterable[str | Item], where: str | None = None, offset_hours: int = 0) -> FlowTable:
    """``SELECT ... FROM table WHERE ...`` without a window."""
    items = select_items(select)
    df = table.df.where(where) if where else table.df
    hidden = [F.col(WINDOW)] if WINDOW in df.columns else []
    columns = [F.expr(expression).alias(name) for expression, name in items]
    return FlowTable(df.select(*row_time_columns(offset_hours), *columns, *hidden), depth=table.depth)
