"""Window aggregation of a stream.

A streaming query may only window on a column with a watermark, which after an aggregation is
``window_time(w)``: the window's end less one microsecond. So when streaming tables are chained,
every window of the following job is laid out ``depth`` microseconds early, by the ``startTime`` of
Spark's ``window``, and its bounds are moved back for the output. The results are those of
windowing the true event time.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F

from rtflow.functions.aggregates import DISTINCT_KEY, is_distinct
from rtflow.operators.grouping import Grouping, or_count
from rtflow.operators.stream_sessions import found_in_chunks, with_sessions
from rtflow.schema import EVENT_TIME, WINDOW

if TYPE_CHECKING:
    from rtflow.operators.windows import WindowSpec


def window_of(time: Column, size: int, step: int, early: int, offset: int = 0) -> Column:
    """Spark's window, starting ``offset`` seconds past the multiples of ``step``."""
    shift = f"{offset * 1_000_000 - early} microseconds"
    return F.window(time, f"{size} seconds", f"{step} seconds", shift)


def moved(ts: Column, microseconds: int) -> Column:
    return ts + F.expr(f"INTERVAL {microseconds} MICROSECONDS") if microseconds else ts


def with_window_input(df: DataFrame, depth: int) -> tuple[DataFrame, Column]:
    """The table with the time column to window on, which is ``depth`` microseconds early."""
    if not depth:
        return df, F.col(EVENT_TIME)
    return df.withColumn("__t", F.window_time(WINDOW)).drop(WINDOW), F.col("__t")


def aggregate(
    df: DataFrame, depth: int, window: WindowSpec, grouping: Grouping
) -> tuple[DataFrame, Column, Column]:
    """The grouped table, with the start and the end of each row's window."""
    df, time = with_window_input(df, depth)
    if window.kind == "session" and not grouping.keys:
        # Spark merges the sessions of a stream only within a key.
        df = df.withColumn("__g", F.lit(0))
        grouping = Grouping({"__g": "__g"}, grouping.aggregates, grouping.having, grouping.split)
    if any(is_distinct(expression) for expression in (*(e for e, _ in grouping.aggregates), grouping.having or "")):
        grouped = _distinct(df, time, window, depth, grouping)
    elif window.kind == "session" and found_in_chunks(df, grouping):
        grouped = grouping.in_one_phase(with_sessions(df, "__t" if depth else EVENT_TIME, window.gap, grouping), WINDOW)
    else:
        # Rows, not panes of rows, meet the watermark: a late row counts in those of its windows that
        # are still open, which its pane would not tell. The map side adds up each window first.
        grouped = grouping.in_one_phase(_assigned(df, time, window, depth), WINDOW)
    end = moved(F.col(f"{WINDOW}.end"), depth)
    start = end - F.expr(f"INTERVAL {window.size} SECONDS") if window.gapped else moved(F.col(f"{WINDOW}.start"), depth)
    return grouped, start, end


def _assigned(df: DataFrame, time: Column, window: WindowSpec, early: int) -> DataFrame:
    """Add the window column; rows in no window are dropped."""
    if window.kind == "session":
        return df.withColumn(WINDOW, F.session_window(time, f"{window.gap} seconds"))
    if window.gapped:
        # Spark wants slide <= size. These are tumbling windows of the slide length that end where
        # the sampling windows end, and of each only the last ``size`` seconds count.
        tumbling = window_of(time, window.slide, window.slide, early, offset=window.size)
        covered = time >= F.col(f"{WINDOW}.end") - F.expr(f"INTERVAL {window.size} SECONDS")
        return df.withColumn(WINDOW, tumbling).where(covered)
    return df.withColumn(WINDOW, window_of(time, window.size, window.step, early))


def _distinct(df: DataFrame, time: Column, window: WindowSpec, early: int, grouping: Grouping) -> DataFrame:
    """Exact ``count(distinct x)`` on a stream: one state row per value first, then count them."""
    if grouping.split is None or window.kind == "session":
        raise ValueError(
            "on a stream, count(distinct x) works in tumbling and sliding windows, for one x, next to plain "
            "sum, min, max, count and avg; otherwise use approx_count_distinct(x)"
        )
    value = F.expr(grouping.split.distinct).alias(DISTINCT_KEY)
    values = _assigned(df, time, window, early).groupBy(WINDOW, *grouping.key_columns(), value)
    return grouping.last_phase(values.agg(*or_count(grouping.split.partial)), WINDOW)
