"""Window aggregation of a whole table.

A window is known by its start in microseconds since 1970, a plain number. It is a much cheaper
grouping key than Spark's window struct, which would keep aggregation from using its fast hash map;
streams need the struct, because their watermark hangs on it.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F

from rtflow.operators.grouping import Grouping, or_count
from rtflow.schema import EVENT_TIME

if TYPE_CHECKING:
    from rtflow.operators.windows import WindowSpec

MICROS = 1_000_000
START, LAST = "__s", "__e"
PANE = "__p"

#: Panes that one pane of the next level holds, where windows overlap many times.
RADIX = 8

#: How many gap-long panes a block has in which sessions are merged first.
SESSION_BLOCK = 1024


def aligned(micros: Column, length: int) -> Column:
    """The latest multiple of ``length`` at or before the time, also before 1970."""
    return micros - F.pmod(micros, F.lit(length))


def with_start(df: DataFrame, length: int, name: str = START) -> DataFrame:
    """Number the tumbling window of each row. Rows without an event time are in none."""
    micros = F.unix_micros(EVENT_TIME)
    return df.where(F.col(EVENT_TIME).isNotNull()).withColumn(name, aligned(micros, length * MICROS))


def bounds(start: Column, length: int) -> tuple[Column, Column]:
    return F.timestamp_micros(start), F.timestamp_micros(start + F.lit(length * MICROS))


def aggregate(df: DataFrame, window: WindowSpec, grouping: Grouping) -> tuple[DataFrame, Column, Column]:
    """The grouped table, with the start and the end of each row's window."""
    if window.kind == "session":
        if grouping.splits:
            return _sessions_from_panes(df, window.gap, grouping), F.col("__w.start"), F.col("__w.end")
        else:
            sessions = _sessions_of_rows(df, window.gap, grouping)
        return sessions, F.timestamp_micros(START), F.col(LAST) + F.expr(f"INTERVAL {window.gap} SECONDS")
    if window.overlapping:
        grouped = _overlapping(df, window, grouping)
    else:
        rows = with_start(df, window.step)
        if window.gapped:
            rows = rows.where(F.unix_micros(EVENT_TIME) - F.col(START) < F.lit(window.size * MICROS))
        grouped = grouping.in_one_phase(rows, START)
    return (grouped, *bounds(F.col(START), window.size))


def _overlapping(df: DataFrame, window: WindowSpec, grouping: Grouping) -> DataFrame:
    """Reduce rows to panes, then copy panes, not rows, into the windows that hold them.

    A pane is as long as the greatest common divisor of size and slide, so no window starts or
    ends inside one. Aggregates that cannot be combined have their rows copied. Windows of more than
    twice ``RADIX`` slides are put together from longer and longer panes instead.
    """
    if not grouping.splits:
        rows = df.where(F.col(EVENT_TIME).isNotNull())
        return grouping.in_one_phase(_copied(rows, F.unix_micros(EVENT_TIME), window), START)
    if window.size > 2 * RADIX * window.slide:
        return _from_levels(df, window, grouping)
    panes = grouping.first_phase(with_start(df, math.gcd(window.size, window.slide), PANE), PANE)
    return grouping.last_phase(_copied(panes, F.col(PANE), window), START)


def _from_levels(df: DataFrame, window: WindowSpec, grouping: Grouping) -> DataFrame:
    """Put windows together from panes of 1, ``RADIX``, ``RADIX`` squared... slides, one at each slide.

    A window is some slides long, and the head of one more. A level's panes are merged from ``RADIX`` panes
    each of the level below, so a pane is copied ``RADIX`` times for a level and at most that often into
    windows: for a window of 500 slides about 40 copies in all instead of 500. Every step is an aggregation
    by pane and key with a map-side part, so a hot key is spread over its panes.
    """
    slide = window.slide * MICROS
    slides, rest = divmod(window.size, window.slide)
    rows = with_start(df, window.slide, PANE)
    merge = or_count(grouping.split.merge)
    pieces = []
    if rest:
        head = F.unix_micros(EVENT_TIME) - F.col(PANE) < F.lit(rest * MICROS)
        parts = grouping.first_phase(rows.withColumn("__head", head), PANE, "__head")
        pieces.append(parts.where("__head").drop("__head").withColumn(START, F.col(PANE) - F.lit(slides * slide)))
        level = parts.groupBy(PANE, *grouping.keys).agg(*merge)
    else:
        level = grouping.first_phase(rows, PANE)

    def before(first: int, number: int, length: int) -> Column:
        """The starts so many slides before a pane: ``first``, and ``number - 1`` more that are ``length`` apart."""
        last = F.col(PANE) - F.lit(first * slide)
        return F.explode(F.sequence(last - F.lit((number - 1) * length * slide), last, F.lit(length * slide)))

    covered, length = 0, 1
    while covered < slides:
        number = slides // length % RADIX
        if number:
            pieces.append(level.withColumn(START, before(covered, number, length)))
            covered += number * length
        if covered < slides:
            level = level.withColumn(PANE, before(0, RADIX, length)).groupBy(PANE, *grouping.keys).agg(*merge)
            length *= RADIX
    return grouping.last_phase(reduce(DataFrame.unionByName, pieces), START)


def _copied(df: DataFrame, micros: Column, window: WindowSpec) -> DataFrame:
    """One copy per window that holds the time, with the start of that window."""
    slide, size = window.slide * MICROS, window.size * MICROS
    last = aligned(micros, slide)
    copies = math.ceil(size / slide)
    starts = F.sequence(last - F.lit((copies - 1) * slide), last, F.lit(slide))
    df = df.withColumn(START, F.explode(starts))
    return df.where(F.col(START) + F.lit(size) > micros) if size % slide else df


# Sessions -------------------------------------------------------------------------------------
#
# A pane is as long as the session gap. The rows of a key within one pane are less than a gap
# apart, so they share a session whatever else there is. Reducing rows to panes is a plain hash
# aggregation with a map-side part, and it spreads a hot key over its panes. Panes are merged to
# sessions in blocks of time, which spreads a hot key, or a table without keys, over its blocks;
# then only sessions on the edges of blocks are left to be merged with each other.


def span(gap: int) -> Column:
    """The session window of rows known to belong together: from the first to a gap after the last."""
    width = F.unix_micros("__last") - F.unix_micros("__first") + F.lit(gap * MICROS)
    seconds = (width.cast("decimal(18,0)") * F.expr("0.000001BD")).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.session_window("__first", F.make_interval(zero, zero, zero, zero, zero, zero, seconds)).alias("__w")


def _sessions_from_panes(df: DataFrame, gap: int, grouping: Grouping) -> DataFrame:
    panes = grouping.first_phase(with_start(df, gap, PANE), PANE, extra=_extent(EVENT_TIME, EVENT_TIME))
    return grouping.last_phase(_merged_in_blocks(panes, gap, list(grouping.keys), grouping.split.merge), span(gap), "__b")


def _extent(first: str, last: str) -> tuple[Column, Column]:
    return F.min(first).alias("__first"), F.max(last).alias("__last")


def _merged_in_blocks(panes: DataFrame, gap: int, keys: list[str], merge: list[Column]) -> DataFrame:
    """Merge panes in blocks of time, so that not all of a key meet in one task.

    A session that stays a gap away from both ends of its block is whole, and keeps the block as a
    key of the final merge. The others, at most two per key and block, are merged there under one.
    """
    length = SESSION_BLOCK * gap * MICROS
    blocks = panes.withColumn("__b", aligned(F.col(PANE), length)).groupBy(span(gap), "__b", *keys)
    sessions = blocks.agg(*_extent("__first", "__last"), *merge).drop("__w")
    first, last = F.unix_micros("__first"), F.unix_micros("__last")
    margin = F.lit(gap * MICROS)
    inside = (first - margin >= F.col("__b")) & (last + margin < F.col("__b") + F.lit(length))
    return sessions.withColumn("__b", F.when(inside, F.col("__b")))


def _sessions_of_rows(df: DataFrame, gap: int, grouping: Grouping) -> DataFrame:
    """Sessions for aggregates that cannot be split: find them on panes, then look them up by row.

    A session has rows in all panes from its first row's to its last row's, and no other session of
    its key has any there. Rows meet their session by key and pane, and once each knows its session
    the aggregation is an ordinary one.
    """
    keys = list(grouping.keys)
    rows = with_start(df, gap, PANE).select("*", *grouping.key_columns())
    panes = rows.groupBy(PANE, *keys).agg(*_extent(EVENT_TIME, EVENT_TIME))
    sessions = _merged_in_blocks(panes, gap, keys, []).groupBy(span(gap), "__b", *keys).agg(*_extent("__first", "__last"))
    first, last, step = F.unix_micros("__first"), F.unix_micros("__last"), gap * MICROS
    covered = F.sequence(aligned(first, step), aligned(last, step), F.lit(step).cast("bigint"))
    panes = sessions.select(first.alias(START), F.explode(covered).alias("__q"), *[F.col(key).alias(f"{key}q") for key in keys])
    on = F.col(PANE) == F.col("__q")
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"{key}q"))
    return grouping.in_one_phase(rows.join(panes, on), START, extra=(F.max(EVENT_TIME).alias(LAST),))
