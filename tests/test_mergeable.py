"""Aggregates in two and three phases against Spark's own in one."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rtflow.functions.aggregates import split_aggregates


def both(df, *expressions):
    """The results in one phase, in two, and with a merge between them, as sorted rows."""
    items = [(e, f"a{i}") for i, e in enumerate(expressions)]
    split = split_aggregates(df, items)
    one = df.groupBy("k").agg(*[F.expr(e).alias(a) for e, a in items])
    names = ["k", *[a for _, a in items]]
    parts = df.groupBy("k", "p").agg(*split.partial)
    merged = parts.groupBy("k", (F.col("p") % 2).alias("p")).agg(*split.merge)
    out = [one]
    for df in (parts, merged):
        out.append(df.groupBy("k").agg(*split.final).withColumns(split.outputs).select(*names))
    assert [f.dataType for f in out[1].schema] == [f.dataType for f in one.schema] == [f.dataType for f in out[2].schema]
    return [sorted(map(tuple, df.collect())) for df in out]


@pytest.mark.parametrize("precision,scale", [(1, 1), (4, 0), (5, 1), (12, 2), (20, 4), (24, 0), (24, 18), (24, 24)])
def test_averages_of_decimals_are_exact(spark, precision, scale):
    rng = random.Random(precision)
    most = 10**precision - 1
    rows = [
        (rng.randrange(60), rng.randrange(5), None if rng.random() < 0.1 else Decimal(rng.randint(-most, most)).scaleb(-scale))
        for _ in range(800)
    ] + [(99, 0, None)]
    df = spark.createDataFrame(rows, f"k int, p int, x decimal({precision},{scale})")
    one, two, three = both(df, "avg(x)", "mean(x)", "avg(x) + 1")
    assert one == two == three


def test_averages_that_division_has_no_room_for_are_not_split(spark):
    df = spark.createDataFrame([], "k int, x decimal(25,3), y decimal(38,18), z decimal(24,3)")
    assert split_aggregates(df, [("avg(x)", "a")]) is None and split_aggregates(df, [("avg(y)", "a")]) is None
    assert split_aggregates(df, [("avg(z)", "a"), ("max(y)", "b")]) is not None


def test_moments(spark):
    rng = random.Random(3)
    number = lambda: None if rng.random() < 0.1 else 1e9 + rng.gauss(0, 1)
    rows = [(rng.randrange(30), rng.randrange(6), number(), number()) for _ in range(900)]
    rows += [(100, 0, 5.0, None), (101, 0, None, None), (102, 0, 5.0, 6.0), (103, 0, 1.0, 2.0), (103, 1, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k int, p int, x double, y double")
    names = ("var_pop", "var_samp", "variance", "stddev", "std", "stddev_pop", "stddev_samp")
    one, *others = both(df, *[f"{n}(x)" for n in names], "covar_pop(x, y)", "covar_samp(x, y)", "var_pop(cast(x as int))")
    for other in others:
        for want, got in zip(one, other, strict=True):
            assert [x is None for x in got] == [x is None for x in want] and got[0] == want[0]
            # The mean is 10**9 times the deviation: differences of large sums would leave no digit.
            pairs = [(g, w) for g, w in zip(got, want, strict=True) if w is not None]
            assert [g for g, _ in pairs] == pytest.approx([w for _, w in pairs], rel=1e-6, abs=1e-6)


def test_extremes_sets_and_bits(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(30), rng.randrange(6), rng.randrange(8), i if rng.random() < 0.8 else None) for i in range(500)]
    rows += [(100, 0, 1, None), (100, 1, 2, None)]
    df = spark.createDataFrame(rows, "k int, p int, x int, y int")
    one, two, three = both(
        df, "min_by(x, y)", "max_by(x + 1, y)", "sort_array(collect_set(x))", "sort_array(collect_set(y))", "bool_and(x > 2)",
        "every(y > 3)", "bool_or(y > 490)", "any(x = 7)", "bit_and(x)", "bit_or(x)", "bit_xor(y)", "count_if(y > 100)",
        "size(collect_set(if(x > length(')'), x, 0))) + max(y)",
    )
    assert one == two == three


@pytest.mark.parametrize("call", ["min_by(x)", "max_by(x, y, z)", "covar_pop(x)", "sum(x, y)", "corr(x, y)", "median(x)", "collect_list(x)"])
def test_what_is_not_split(spark, call):
    df = spark.createDataFrame([], "x int, y int, z int")
    assert split_aggregates(df, [(call, "a")]) is None
