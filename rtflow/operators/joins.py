"""Stream-stream joins within a tumbling window, and stream-static joins per row."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rtflow.operators.projection import Item, plain_column, row_time_columns, select_items, time_columns
from rtflow.operators.batch_windows import bounds, with_start
from rtflow.operators.stream_windows import moved, window_of, with_window_input
from rtflow.schema import EVENT_TIME, WINDOW
from rtflow.table import FlowTable

INNER, LEFT, RIGHT = "inner", "left", "right"
_HOW = (INNER, LEFT, RIGHT)
_FILLS = ("sql", "text")

#: Tasks' worth of state that kept rows with a null key are spread over, as they meet no other row.
NULL_SPREAD = 1024

#: Fixed value: the text that stands for a missing match with ``null_fill="text"``.
NULL_TEXT = "NULL"


@dataclass(frozen=True)
class JoinSpec:
    """An equality join of two tables on one column each."""

    left: str
    right: str
    left_key: str
    right_key: str
    how: str = INNER
    left_alias: str | None = None
    right_alias: str | None = None

    def __post_init__(self):
        if self.how not in _HOW:
            raise ValueError(f"{self.how!r} joins are not supported, use one of {_HOW}")
        if self.names[0] == self.names[1]:
            raise ValueError(f"both sides of the join are called {self.names[0]!r}: give them aliases")

    @property
    def names(self) -> tuple[str, str]:
        """What columns of the two sides are qualified with."""
        return self.left_alias or self.left, self.right_alias or self.right


def join_windowed(
    left: FlowTable,
    right: FlowTable,
    spec: JoinSpec,
    select: Iterable[str | Item],
    size: int,
    where: str | None = None,
    null_fill: str = "sql",
    salt: int = 1,
    offset_hours: int = 0,
) -> FlowTable:
    """Join the rows of two streams that share a key and a tumbling window of ``size`` seconds.

    The window is part of the join key, so even one dominating key is spread over its windows. In
    batch, AQE splits what skew is left. Stateful streaming joins are out of AQE's reach: ``salt``
    splits every key of a window over that many tasks, at the price of keeping the other side's
    rows ``salt`` times. Rows with a null key that an outer join keeps are always spread, in batch and in
    streams: they match nothing, so nothing is repeated for them.
    """
    if left.static or right.static:
        raise ValueError("a windowed join needs two streams")
    if left.streaming != right.streaming:
        raise ValueError("one side of the windowed join is streaming and the other is not")
    if left.streaming and left.depth != right.depth:
        raise ValueError(
            f"the sides of the join have passed {left.depth} and {right.depth} windowed jobs; "
            "run the data flow in materialised mode, which restarts the event time at every job"
        )
    _check_fill(null_fill)
    _check_salt(salt)

    sides = []
    keys = _keys(left.df, right.df, spec)
    for table, name, key, tag in ((left, spec.names[0], keys[0], "l"), (right, spec.names[1], keys[1], "r")):
        if table.streaming:
            df, time = with_window_input(table.df, table.depth)
            df = df.withColumn(f"__{tag}w", window_of(time, size, size, table.depth))
        else:
            df = with_start(table.df, size, f"__{tag}w")
        df = df.alias(name).withColumn(f"__{tag}k", key)
        sides.append(df.withColumn(f"__{tag}m", F.lit(True)))
    lhs, rhs = sides
    on = (F.col("__lw") == F.col("__rw")) & (F.col("__lk") == F.col("__rk"))
    if spec.how != INNER:
        lhs, rhs = _nulls_spread(lhs, rhs, spec, select)
        on = on & (F.col("__ln") == F.col("__rn"))
    if salt > 1:
        lhs, rhs = _salted(lhs, rhs, salt, spec, select)
        on = on & (F.col("__ls") == F.col("__rs"))
    joined = lhs.join(rhs, on, spec.how)
    if where:
        joined = joined.where(where)

    window = F.col("__rw" if spec.how == RIGHT else "__lw")
    if left.streaming:
        start, end = moved(window["start"], left.depth), moved(window["end"], left.depth)
        hidden = [window.alias(WINDOW)]
    else:
        start, end = bounds(window, size)
        hidden = []
    result = joined.select(
        *time_columns(end, start, end, offset_hours),
        *_columns(left.df, right.df, spec, select, null_fill),
        *hidden,
    )
    return FlowTable(result, depth=left.depth + 1 if left.streaming else 0)


def join_static(
    stream: FlowTable,
    static: FlowTable,
    spec: JoinSpec,
    select: Iterable[str | Item],
    where: str | None = None,
    null_fill: str = "sql",
    salt: int = 1,
    offset_hours: int = 0,
) -> FlowTable:
    """Look every row of a stream up in a static table.

    There is no broadcast hint: Spark broadcasts the static side when its size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides, with AQE's skew handling,
    when it is not. Where AQE is off, ``salt`` splits hot keys as in :func:`join_windowed`.
    """
    if stream.static or not static.static:
        raise ValueError("a static join needs a stream on the left and a static table on the right")
    if spec.how == RIGHT:
        raise ValueError("a right join with a static table is not supported: it has no event time for the misses")
    _check_fill(null_fill)
    left_name, right_name = spec.names
    lhs = stream.df.alias(left_name)
    rhs = static.df.alias(right_name).withColumn("__rm", F.lit(True))
    left_key, right_key = _keys(stream.df, static.df, spec)
    on = left_key == right_key
    _check_salt(salt)
    if spec.how == LEFT and stream.streaming:  # in batch AQE splits them, or nothing is shuffled
        lhs, rhs = _nulls_spread(lhs.withColumn("__lk", left_key), rhs.withColumn("__rk", right_key), spec, select)
        on = on & (F.col("__ln") == F.col("__rn"))
    if salt > 1:
        lhs, rhs = _salted(lhs, rhs, salt, spec, select)
        on = on & (F.col("__ls") == F.col("__rs"))
    joined = lhs.join(rhs, on, spec.how)
    if where:
        joined = joined.where(where)
    times = row_time_columns(offset_hours)
    hidden = [F.col(WINDOW)] if WINDOW in stream.df.columns else []
    result = joined.select(*times, *_columns(stream.df, static.df, spec, select, null_fill), *hidden)
    return FlowTable(result, depth=stream.depth)


def _quoted(table: str, column: str) -> str:
    return f"`{table}`.`{column}`"


def _keys(left: DataFrame, right: DataFrame, spec: JoinSpec) -> tuple[Column, Column]:
    """The key columns of both sides, compared as text if one is text and the other is not."""
    columns = []
    for df, name, key in ((left, spec.names[0], spec.left_key), (right, spec.names[1], spec.right_key)):
        if key not in df.columns:
            raise ValueError(f"join key {key!r} is not a column of {name!r}")
        columns.append((F.col(_quoted(name, key)), df.schema[key].dataType))
    (left_key, left_type), (right_key, right_type) = columns
    if left_type != right_type and isinstance(left_type, T.StringType) != isinstance(right_type, T.StringType):
        # Spark would cast the text, and fail on the first one that is no number.
        left_key, right_key = left_key.cast("string"), right_key.cast("string")
    return left_key, right_key


def _check_fill(null_fill: str) -> None:
    if null_fill not in _FILLS:
        raise ValueError(f"null_fill must be one of {_FILLS}")


def _check_salt(salt: int) -> None:
    if salt < 1:
        raise ValueError("salt must be at least 1")


def _content(df: DataFrame, name: str, key: str, select: Iterable[str | Item]) -> list[Column]:
    """The event time, the key and the columns that the join reads anyway, so a hash of them costs no reading."""
    wanted = {key, EVENT_TIME, *((plain_column(expression) or (None, ""))[1] for expression, _ in select_items(select))}
    return [F.col(_quoted(name, c)) for c in df.columns if c in wanted]


def _nulls_spread(
    lhs: DataFrame, rhs: DataFrame, spec: JoinSpec, select: Iterable[str | Item]
) -> tuple[DataFrame, DataFrame]:
    """Add ``__ln`` and ``__rn`` to the join key: 0, but for rows of the kept side whose key is null.

    Those would all meet in one task of a window. The other side's 0 is written so that Spark does not
    know it as a constant, which it would put into the condition instead of the column.
    """
    kept = {LEFT: ("l", lhs, spec.names[0], spec.left_key), RIGHT: ("r", rhs, spec.names[1], spec.right_key)}[spec.how]
    tag, df, name, key = kept
    place = F.pmod(F.xxhash64(*_content(df, name, key, select)), F.lit(NULL_SPREAD)).cast("int")
    spread = df.withColumn(f"__{tag}n", F.when(F.col(f"__{tag}k").isNull(), place).otherwise(F.lit(0)))
    if tag == "l":
        return spread, rhs.withColumn("__rn", F.pmod(F.hash("__rk"), F.lit(1)))
    return lhs.withColumn("__ln", F.pmod(F.hash("__lk"), F.lit(1))), spread


def _salted(
    lhs: DataFrame, rhs: DataFrame, salt: int, spec: JoinSpec, select: Iterable[str | Item]
) -> tuple[DataFrame, DataFrame]:
    """Spread one side by a hash of its rows and repeat the other for every salt.

    The side whose unmatched rows are kept must be the spread one, or a miss would repeat. The
    hash depends on nothing but the row, so a task that runs again places its rows as before. It
    covers the event time and the columns that the join reads anyway, so the scan reads no more for
    it; rows that are equal in all of those stay together.
    """
    how = spec.how

    def spread(df: DataFrame, tag: str) -> DataFrame:
        name, key = (spec.names[1], spec.right_key) if how == RIGHT else (spec.names[0], spec.left_key)
        return df.withColumn(tag, F.pmod(F.xxhash64(*_content(df, name, key, select)), F.lit(salt)).cast("int"))

    def repeated(df: DataFrame, tag: str) -> DataFrame:
        return df.withColumn(tag, F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))

    if how == RIGHT:
        return repeated(lhs, "__ls"), spread(rhs, "__rs")
    return spread(lhs, "__ls"), repeated(rhs, "__rs")


def _columns(
    left: DataFrame, right: DataFrame, spec: JoinSpec, select: Iterable[str | Item], null_fill: str
) -> list[Column]:
    """The selected columns, those of the left table first, with missing matches filled in."""
    sides: tuple[list[Column], list[Column]] = ([], [])
    frames = (left, right)
    for expression, alias in select_items(select):
        column = plain_column(expression)
        if column is None:
            raise ValueError(f"a join selects plain columns only, not {expression!r}: compute it in another job")
        qualifier, name = column
        if qualifier is None:
            holders = [i for i in (0, 1) if name in frames[i].columns]
            if len(holders) != 1:
                raise ValueError(f"column {name!r} is {'ambiguous' if holders else 'unknown'} in the join: qualify it")
            side = holders[0]
        elif qualifier in (spec.names[0], spec.left):
            side = 0
        elif qualifier in (spec.names[1], spec.right):
            side = 1
        else:
            raise ValueError(f"{expression!r} belongs to neither side of the join {spec.names}")
        value = F.col(_quoted(spec.names[side], name))
        if null_fill == "text" and (spec.how, side) in ((LEFT, 1), (RIGHT, 0)):
            if name not in frames[side].columns:
                raise ValueError(f"column {name!r} is not in table {spec.names[side]!r}")
            value = _filled(value, frames[side].schema[name].dataType, F.col("__lm" if side == 0 else "__rm"))
        sides[side].append(value.alias(alias))
    return [*sides[0], *sides[1]]


def _filled(value: Column, kind: T.DataType, matched: Column) -> Column:
    """Replace the column of a missed match: text by ``NULL_TEXT``, a number by 0. Real nulls stay."""
    if isinstance(kind, T.StringType):
        fill = F.lit(NULL_TEXT)
    elif isinstance(kind, T.NumericType):
        fill = F.lit(0).cast(kind)
    else:
        return value
    return F.when(matched.isNull(), fill).otherwise(value)
