"""Two-phase forms of the plain aggregates.

Several window operators run cheaper, and without a hot task, when rows are first reduced on a
finer grouping and the partial results are combined afterwards. That is possible for calls of the
aggregates in ``SAME``, of counts, averages, variances, covariances, ``min_by``, ``max_by`` and
``collect_set``, and for one ``count(distinct x)``. What is computed from such calls, HAVING included,
is computed from the combined results. For any other expression :func:`split_aggregates` returns
``None`` and the caller aggregates in one phase.

Partial results keep what combining needs to be exact, or as stable as one phase is: averages of
decimals are divided once, at the scale of the result, and moments are kept as count, mean and sum of
squared differences, which are merged pair by pair and never as differences of large sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Aggregates whose partial results the same aggregate combines, and what else is split.
SAME = ("sum", "min", "max", "bool_and", "every", "bool_or", "any", "some", "bit_and", "bit_or", "bit_xor")
_VARIANCES = {
    "var_pop": (0, False), "var_samp": (1, False), "variance": (1, False),
    "stddev_pop": (0, True), "stddev_samp": (1, True), "stddev": (1, True), "std": (1, True),
}
_COVARIANCES = {"covar_pop": 0, "covar_samp": 1}
_TWO = {*_COVARIANCES, "min_by", "max_by"}
_SPLIT = (*SAME, "count", "count_if", "avg", "mean", *_VARIANCES, *sorted(_TWO), "collect_set")
_NAME = re.compile(rf"(?<![\w.`])({'|'.join(_SPLIT)})\s*\(", re.IGNORECASE)
#: The most digits of a decimal whose average is divided from a merged sum.
_MOST_DIGITS = 24
_DISTINCT = re.compile(r"\s*distinct\b(.*)", re.IGNORECASE | re.DOTALL)
DISTINCT_KEY = "__d"


@dataclass
class SplitAggregates:
    #: aggregates of the first phase
    partial: list[Column] = field(default_factory=list)
    #: aggregates of the second phase, over the columns of the first
    final: list[Column] = field(default_factory=list)
    #: aggregates that combine columns of the first phase to columns of the same kind
    merge: list[Column] = field(default_factory=list)
    #: what is computed from the second phase's columns, by output name
    outputs: dict[str, Column] = field(default_factory=dict)
    #: the condition on the second phase's columns and the keys, if there is one
    having: Column | None = None
    #: argument of ``count(distinct ...)``; the first phase also groups by it, as ``__d``
    distinct: str | None = None


def is_distinct(expression: str) -> bool:
    return bool(re.search(r"\(\s*distinct\b", expression, re.IGNORECASE))


def collects_set(expression: str) -> bool:
    return bool(re.search(r"(?<![\w.`])collect_set\s*\(", expression, re.IGNORECASE))


def _end_of_call(text: str, start: int) -> tuple[int, list[str]] | None:
    """The place of the bracket that closes a call whose arguments begin at ``start``, and the arguments."""
    depth, quote, at, begin, arguments = 0, "", start, start, []
    while at < len(text):
        char = text[at]
        if quote:
            at += char == "\\" and quote != "`"
            quote = "" if char == quote else quote
        elif char in "'\"`":
            quote = char
        elif char in ")," and depth == 0:
            arguments.append(text[begin:at].strip())
            if char == ")":
                return (at, arguments) if all(arguments) else None
            begin = at + 1
        else:
            depth += (char == "(") - (char == ")")
        at += 1
    return None


def _quoted_parts(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", text, re.DOTALL)]


def _lifted(expression: str, calls: dict[tuple[str, ...], str]) -> str | None:
    """The expression with each plain call replaced by a column; ``calls`` collects those columns."""
    out, at = [], 0
    quoted = _quoted_parts(expression)
    for found in _NAME.finditer(expression):
        if found.start() < at or any(a <= found.start() < b for a, b in quoted):
            continue
        closed, name = _end_of_call(expression, found.end()), found[1].lower()
        if closed is None or len(closed[1]) != 1 + (name in _TWO):
            return None
        end, arguments = closed
        out += [expression[at : found.start()], calls.setdefault((name, *arguments), f"__c{len(calls)}")]
        at = end + 1
    return "".join([*out, expression[at:]])


def _renamed(expression: str, column: str, name: str) -> str:
    """The expression with a column renamed wherever it stands unqualified, outside of text."""
    texts = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
    place = rf"(?<![\w.`])(?:`{column}`|{column}(?![\w`(.]))"
    return re.sub(f"{texts}|{place}", lambda m: m[0] if m[0][0] in "'\"" else name, expression, flags=re.DOTALL)


def _digits(df: DataFrame, expression: str) -> int:
    """The precision of a decimal expression."""
    kind = df.select(F.expr(expression)).schema[0].dataType
    return kind.precision if isinstance(kind, T.DecimalType) else 38


def _computed(expressions: Iterable[str], names: Iterable[T.StructField], df: DataFrame) -> bool:
    """Whether the expressions need the given columns only, and no aggregate that was not split."""
    empty = df.sparkSession.createDataFrame([], T.StructType(list(names)))
    try:
        for expression in expressions:
            empty.where(F.expr(expression).isNotNull()).schema  # a condition can't hold aggregates
    except (AnalysisException, ParseException):
        return False
    return True


# Moments --------------------------------------------------------------------------------------
#
# A state is the number of rows, their mean, and the sum of squared differences from it; for two columns
# both means, and the sum of products of differences. Two states make one without loss of digits.


def _moments(x: str) -> Column:
    return F.expr(f"named_struct('n', count({x}), 'mean', coalesce(avg({x}), 0D), 'm2', coalesce(var_pop({x}) * count({x}), 0D))")


def _co_moments(x: str, y: str) -> Column:
    return F.expr(
        f"named_struct('n', count({x}), 'mean', coalesce(avg({x}), 0D), 'other', coalesce(avg({y}), 0D), "
        f"'c', coalesce(covar_pop({x}, {y}) * count({x}), 0D))"
    )


def _merged_moments(states: str) -> Column:
    def merge(a: Column, b: Column) -> Column:
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        share = b["n"] / F.greatest(n, F.lit(1))
        return F.struct(
            n.alias("n"), (a["mean"] + gap * share).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * share).alias("m2")
        )

    return F.aggregate(F.collect_list(states), F.expr("named_struct('n', 0L, 'mean', 0D, 'm2', 0D)"), merge)


def _merged_co_moments(states: str) -> Column:
    def merge(a: Column, b: Column) -> Column:
        n, gap, other = a["n"] + b["n"], b["mean"] - a["mean"], b["other"] - a["other"]
        share = b["n"] / F.greatest(n, F.lit(1))
        return F.struct(
            n.alias("n"),
            (a["mean"] + gap * share).alias("mean"),
            (a["other"] + other * share).alias("other"),
            (a["c"] + b["c"] + gap * other * a["n"] * share).alias("c"),
        )

    return F.aggregate(F.collect_list(states), F.expr("named_struct('n', 0L, 'mean', 0D, 'other', 0D, 'c', 0D)"), merge)


def _spread(state: Column, total: str, less: int, root: bool = False) -> Column:
    """A variance or covariance of a merged state; null for too few rows."""
    value = F.when(state["n"] > less, state[total] / (state["n"] - less))
    return F.sqrt(value) if root else value


def _decimal_average(total: Column, number: Column, kind: T.DecimalType) -> Column:
    """A sum of decimals by a count, rounded once, to the ``kind`` that Spark's average has.

    Spark gives a quotient six digits after the point at least, and as many as 38 digits leave room for
    before it. So the sum is cast to the digits that leave room for just the result's scale; sums of whole
    numbers are divided a hundredth as large, and those of tenths a tenth.
    """
    scale = kind.scale - 4
    shift = max(0, 2 - scale)
    digits = 34 - shift
    small = total.cast(T.DecimalType(digits, scale)) * F.lit(Decimal(1).scaleb(-shift)) if shift else total
    quotient = F.try_divide(small.cast(T.DecimalType(34, scale + shift)), number.cast(T.DecimalType(20, 0)))
    return (quotient * F.lit(10**shift) if shift else quotient).cast(kind)


def split_aggregates(
    df: DataFrame, items: Sequence[tuple[str, str]], having: str | None = None, keys: Sequence[tuple[str, str]] = ()
) -> SplitAggregates | None:
    """Split ``(expression, alias)`` aggregates over ``df`` into a partial and a combining phase.

    ``keys`` are the ``(expression, name)`` that rows are grouped by: HAVING may use those that are
    plain columns. Results have the types that Spark gives the expressions in one phase.
    """
    calls: dict[tuple[str, ...], str] = {}
    rests = [_lifted(expression, calls) for expression, _ in items]
    condition = _lifted(having, calls) if having else None
    if None in rests or (having and condition is None):
        return None
    split = SplitAggregates()
    if calls:
        try:
            typed = df.groupBy().agg(*[F.expr(f"{name}({', '.join(arguments)})").alias(c) for (name, *arguments), c in calls.items()])
            fields = list(typed.schema)
        except (AnalysisException, ParseException):
            return None
    else:
        fields = []
    kinds = {f.name: f.dataType for f in fields}
    for (name, argument, *more), column in calls.items():
        distinct = _DISTINCT.fullmatch(argument)
        if distinct is not None:
            argument = distinct[1].strip()
            if name != "count" or split.distinct not in (None, argument):
                return None
            split.distinct = argument
            split.final.append(F.count(DISTINCT_KEY).alias(column))
            continue
        part, kind = f"__p{column[3:]}", kinds[column]
        if name in ("avg", "mean"):
            if isinstance(kind, T.DecimalType):
                # Beyond, a sum of more digits than the division has room for could be divided in one phase.
                if _digits(df, argument) > _MOST_DIGITS:
                    return None
                number, average = argument, _decimal_average(F.sum(part), F.sum(f"{part}n"), kind)
            elif isinstance(kind, T.DoubleType):
                number, average = f"CAST({argument} AS DOUBLE)", F.try_divide(F.sum(part), F.sum(f"{part}n"))
            else:  # averages of intervals
                return None
            split.partial += [F.expr(f"sum({number})").alias(part), F.expr(f"count({argument})").alias(f"{part}n")]
            split.merge += [F.sum(part).alias(part), F.sum(f"{part}n").alias(f"{part}n")]
            split.final.append(average.alias(column))
        elif name in _VARIANCES:
            less, root = _VARIANCES[name]
            split.partial.append(_moments(f"CAST({argument} AS DOUBLE)").alias(part))
            split.merge.append(_merged_moments(part).alias(part))
            split.final.append(_spread(_merged_moments(part), "m2", less, root).alias(column))
        elif name in _COVARIANCES:
            both = [f"CASE WHEN ({b}) IS NOT NULL THEN CAST({a} AS DOUBLE) END" for a, b in ((argument, *more), (*more, argument))]
            split.partial.append(_co_moments(*both).alias(part))
            split.merge.append(_merged_co_moments(part).alias(part))
            split.final.append(_spread(_merged_co_moments(part), "c", _COVARIANCES[name]).alias(column))
        elif name in ("min_by", "max_by"):
            by, least = (F.min_by, F.min) if name == "min_by" else (F.max_by, F.max)
            order = more[0]
            split.partial += [F.expr(f"{name}({argument}, {order})").alias(part), F.expr(f"{name[:3]}({order})").alias(f"{part}o")]
            split.merge += [by(part, f"{part}o").alias(part), least(f"{part}o").alias(f"{part}o")]
            split.final.append(by(part, f"{part}o").alias(column))
        elif name == "collect_set":
            united = F.array_distinct(F.flatten(F.collect_list(part)))
            split.partial.append(F.expr(f"collect_set({argument})").alias(part))
            split.merge.append(united.alias(part))
            split.final.append(united.alias(column))
        else:
            split.partial.append(F.expr(f"{name}({argument})").alias(part))
            combine = F.sum if name.startswith("count") else lambda c, name=name: F.expr(f"{name}({c})")
            split.merge.append(combine(part).cast(kind).alias(part))
            split.final.append(combine(part).cast(kind).alias(column))
    grouped = []
    if having:
        for expression, name in keys:
            plain = re.fullmatch(r"\s*`?([^\W\d]\w*)`?\s*", expression)
            if plain and plain[1] in df.columns:
                condition = _renamed(condition, plain[1], name)
                grouped.append(T.StructField(name, df.schema[plain[1]].dataType))
    if not _computed(rests, fields, df) or (having and not _computed([condition], [*fields, *grouped], df)):
        return None
    split.outputs = {alias: F.expr(rest) for rest, (_, alias) in zip(rests, items)}
    split.having = F.expr(condition) if having else None
    return split
