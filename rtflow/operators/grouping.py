"""What to group by and to compute, apart from the window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rtflow.functions.aggregates import SplitAggregates
from rtflow.operators.projection import Item


def or_count(columns: list[Column]) -> list[Column]:
    """Spark's ``agg`` wants an aggregate even if only keys are asked for."""
    return columns or [F.count(F.lit(1)).alias("__n")]


@dataclass(frozen=True)
class Grouping:
    #: name of the key in grouped results -> its expression on the rows
    keys: dict[str, str]
    aggregates: list[Item]
    having: str | None
    #: the aggregates in two phases, if they can be had so
    split: SplitAggregates | None

    @property
    def splits(self) -> bool:
        """Whether partial results may be combined freely, which distinct counts may not."""
        return self.split is not None and self.split.distinct is None

    def key_columns(self) -> list[Column]:
        return [F.expr(expression).alias(name) for name, expression in self.keys.items()]

    def in_one_phase(self, df: DataFrame, *windows: Column | str, extra: tuple[Column, ...] = ()) -> DataFrame:
        columns = [*extra, *self._one_phase_columns()]
        grouped = df.groupBy(*windows, *self.key_columns()).agg(*or_count(columns))
        return grouped.where("__h") if self.having else grouped

    def _one_phase_columns(self) -> list[Column]:
        columns = [F.expr(expression).alias(name) for expression, name in self.aggregates]
        if self.having:
            columns.append(F.expr(self.having).alias("__h"))
        return columns

    def first_phase(self, df: DataFrame, *groups: Column | str, extra: tuple[Column, ...] = ()) -> DataFrame:
        columns = [*extra, *self.split.partial]
        return df.groupBy(*groups, *self.key_columns()).agg(*or_count(columns))

    def last_phase(self, df: DataFrame, *groups: Column | str) -> DataFrame:
        grouped = df.groupBy(*groups, *self.keys).agg(*or_count(self.split.final))
        if self.split.having is not None:
            grouped = grouped.where(self.split.having)
        return grouped.withColumns(self.split.outputs) if self.split.outputs else grouped
