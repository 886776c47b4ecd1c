import pytest

import helpers
from rtflow import FlowTable, JoinSpec, WindowSpec, join_static, join_windowed, window_aggregate
from rtflow.sources import read_jdbc
from rtflow.streaming import run_available

LEFT = ("k string", "v bigint")
RIGHT = ("key string", "w string", "x double")
SELECT = ["b.w", "a.v", "b.x", "a.k"]

ROWS_A = [(1, "p", 1), (2, "p", 2), (3, "q", 3), (4, None, 4), (11, "p", 5), (25, "r", 6), (None, "p", 7), (40, "z", 8)]
ROWS_B = [(5, "p", "P1", 1.0), (9, "p", "P2", None), (10, "p", "P3", 3.0), (12, "s", "S", 4.0), (6, None, "N", 5.0), (41, "y", "Y", 0.0)]

MATCHES = [
    (10.0, 1, "p", "P1", 1.0),
    (10.0, 1, "p", "P2", None),
    (10.0, 2, "p", "P1", 1.0),
    (10.0, 2, "p", "P2", None),
    (20.0, 5, "p", "P3", 3.0),
]
LEFT_MISSES = [(10.0, 3, "q", None, None), (10.0, 4, None, None, None), (30.0, 6, "r", None, None), (50.0, 8, "z", None, None)]
RIGHT_MISSES = [(20.0, None, None, "S", 4.0), (10.0, None, None, "N", 5.0), (50.0, None, None, "Y", 0.0)]
COLUMNS = ("v", "k", "w", "x")


def spec(how):
    return JoinSpec("ta", "tb", "k", "key", how, "a", "b")


def sides(spark):
    return helpers.table(spark, ROWS_A, LEFT), helpers.table(spark, ROWS_B, RIGHT)


def want(*parts):
    return sorted((row for part in parts for row in part), key=repr)


EXPECTED = {
    "inner": want(MATCHES),
    "left": want(MATCHES, LEFT_MISSES),
    "right": want(MATCHES, RIGHT_MISSES),
}


@pytest.mark.parametrize("how", EXPECTED)
@pytest.mark.parametrize("salt", [1, 3])
def test_batch(spark, how, salt):
    a, b = sides(spark)
    got = join_windowed(FlowTable(a), FlowTable(b), spec(how), SELECT, 10, salt=salt).df
    assert got.columns == ["event_time", "window_start", "window_end", "v", "k", "w", "x"]
    assert helpers.result(got, *COLUMNS) == EXPECTED[how]
    first = got.orderBy("event_time").first()
    assert (first.window_start, first.window_end) == (helpers.utc_text(0), helpers.utc_text(10))


@pytest.mark.parametrize("how,salt", [("inner", 1), ("left", 1), ("right", 1), ("left", 3), ("right", 3)])
def test_stream(spark, tmp_path, how, salt):
    a, b = sides(spark)
    left = FlowTable(helpers.as_stream(spark, a, tmp_path / "a"))
    right = FlowTable(helpers.as_stream(spark, b, tmp_path / "b"))
    got = run_available(join_windowed(left, right, spec(how), SELECT, 10, salt=salt).df, str(tmp_path / "run"))
    # The watermark is 38: the windows that end at 50 are open, and so are their misses.
    assert helpers.result(got, *COLUMNS) == [row for row in EXPECTED[how] if row[0] < 50]


def test_chain_after_outer_joins_on_a_stream(spark, tmp_path):
    a, b = sides(spark)
    for how in ("left", "right"):
        left = FlowTable(helpers.as_stream(spark, a, tmp_path / how / "a"))
        right = FlowTable(helpers.as_stream(spark, b, tmp_path / how / "b"))
        joined = join_windowed(left, right, spec(how), SELECT, 10)
        counted = window_aggregate(joined, WindowSpec("tumble", size=10), ["count(*) as n", "count(x) as xs"])
        got = run_available(counted.df, str(tmp_path / how / "run"))
        batch = window_aggregate(
            join_windowed(FlowTable(a), FlowTable(b), spec(how), SELECT, 10),
            WindowSpec("tumble", size=10),
            ["count(*) as n", "count(x) as xs"],
        )
        assert helpers.result(got, "n", "xs") == [row for row in helpers.result(batch.df, "n", "xs") if row[0] <= 38]


def test_text_fill_touches_missed_matches_only(spark):
    a, b = sides(spark)
    got = join_windowed(FlowTable(a), FlowTable(b), spec("left"), SELECT, 10, null_fill="text").df
    filled = [(*row[:3], "NULL", 0.0) for row in LEFT_MISSES]
    assert helpers.result(got, *COLUMNS) == want(MATCHES, filled)
    got = join_windowed(FlowTable(a), FlowTable(b), spec("right"), SELECT, 10, null_fill="text").df
    filled = [(row[0], 0, "NULL", *row[3:]) for row in RIGHT_MISSES]
    assert helpers.result(got, *COLUMNS) == want(MATCHES, filled)


def test_where_sees_the_joined_row(spark):
    a, b = sides(spark)
    got = join_windowed(FlowTable(a), FlowTable(b), spec("left"), SELECT, 10, where="b.w is null and a.v > 3").df
    assert helpers.result(got, *COLUMNS) == want([row for row in LEFT_MISSES if row[1] > 3])


@pytest.mark.parametrize("salt", [1, 4])
def test_static(spark, salt):
    a, _ = sides(spark)
    static = spark.createDataFrame(
        [("p", "P", 1.0), ("p", "PP", 2.0), ("q", None, None), (None, "N", 3.0)], "key string, w string, x double"
    )
    right = FlowTable(static, static=True)
    matched = [(time, v, k, w, x) for time, k, v in ROWS_A for key, w, x in map(tuple, static.collect()) if k == key and k]
    missed = [(time, v, k) for time, k, v in ROWS_A if k not in ("p", "q")]

    def rows(how, **options):
        got = join_static(FlowTable(a), right, spec(how), SELECT, salt=salt, **options).df
        known = got.where("event_time is not null")
        return helpers.result(known, *COLUMNS), got

    matched_known = [row for row in matched if row[0] is not None]
    assert rows("inner")[0] == want(matched_known)
    got, df = rows("left")
    assert got == want(matched_known, [(*row, None, None) for row in missed])
    assert df.where("event_time is null").count() == 2
    first = df.where("v = 6").first()
    assert first.window_start == first.window_end == helpers.utc_text(25)
    assert rows("left", null_fill="text")[0] == want(matched_known, [(*row, "NULL", 0.0) for row in missed])
    with pytest.raises(ValueError, match="right join"):
        rows("right")


def test_column_errors(spark):
    a, b = sides(spark)
    left, right = FlowTable(a), FlowTable(b.withColumnRenamed("w", "v"))

    def join(select):
        return join_windowed(left, right, spec("inner"), select, 10)

    with pytest.raises(ValueError, match="ambiguous"):
        join(["v"])
    with pytest.raises(ValueError, match="ambiguous output"):
        join(["a.v", "b.v"])
    assert join(["a.v", "b.v as w"]).df.columns[3:] == ["v", "w"]
    with pytest.raises(ValueError, match="plain columns"):
        join(["upper(a.k) as u"])
    with pytest.raises(ValueError, match="neither side"):
        join(["c.v"])
    with pytest.raises(ValueError, match="cannot be selected"):
        join(["a.event_time"])


def test_bad_joins(spark, tmp_path):
    a, b = sides(spark)
    for how in ("full", "cross", "leftsemi"):
        with pytest.raises(ValueError, match="not supported"):
            spec(how)
    with pytest.raises(ValueError, match="aliases"):
        JoinSpec("t", "t", "k", "k")
    with pytest.raises(ValueError, match="streaming"):
        stream = FlowTable(helpers.as_stream(spark, a, tmp_path / "a"))
        join_windowed(stream, FlowTable(b), spec("inner"), SELECT, 10)
    with pytest.raises(ValueError, match="materialised"):
        deeper = window_aggregate(stream, WindowSpec("tumble", size=5), ["k", "max(v) as v"], ["k"])
        other = FlowTable(helpers.as_stream(spark, b, tmp_path / "b"))
        join_windowed(deeper, other, spec("inner"), SELECT, 10)
    with pytest.raises(ValueError, match="null_fill"):
        join_windowed(FlowTable(a), FlowTable(b), spec("inner"), SELECT, 10, null_fill="zero")
    with pytest.raises(ValueError, match="salt"):
        join_windowed(FlowTable(a), FlowTable(b), spec("inner"), SELECT, 10, salt=0)


def test_keys_of_different_types(spark):
    a = helpers.table(spark, [(1, 7, 1), (2, 8, 2)], ("k bigint", "v bigint"))
    b = helpers.table(spark, [(3, "7", "P", 1.0), (4, "seven", "Q", 2.0)], RIGHT)
    got = join_windowed(FlowTable(a), FlowTable(b), spec("inner"), SELECT, 10).df
    assert helpers.result(got, *COLUMNS) == [(10.0, 1, 7, "P", 1.0)]
    static = FlowTable(b.drop("event_time"), static=True)
    assert helpers.result(join_static(FlowTable(a), static, spec("left"), SELECT).df, *COLUMNS) == [
        (1.0, 1, 7, "P", 1.0),
        (2.0, 2, 8, None, None),
    ]
    with pytest.raises(ValueError, match="join key"):
        join_static(FlowTable(a), static, JoinSpec("ta", "tb", "k", "nothing"), SELECT)


def test_salting_reads_no_further_columns(spark, tmp_path):
    helpers.table(spark, [(1, 1, "x", "long")], ("k bigint", "v string", "unused string")).write.parquet(str(tmp_path / "t"))
    a, b = (FlowTable(spark.read.parquet(str(tmp_path / "t"))) for _ in "ab")
    join = JoinSpec("a", "b", "k", "k", "left")
    out = join_windowed(a, b, join, ["a.k", "b.v"], 10, salt=4).df
    assert "unused" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_table_is_not_read_over_jdbc_in_one_task_unasked(spark):
    for options in ({}, {"numPartitions": "8"}):
        with pytest.raises(ValueError, match="partitionColumn"):
            read_jdbc(spark, "t", None, {"url": "jdbc:mysql://nowhere/x", **options})


@pytest.mark.parametrize("how", ["left", "right"])
@pytest.mark.parametrize("streaming", [False, True])
def test_null_keys_are_spread(spark, tmp_path, how, streaming):
    """Kept rows with a null key are in many partitions of the join, and the others where they were."""
    rows = [(i % 10, None if i % 2 else "p", i) for i in range(400)]
    a, b = helpers.table(spark, rows, LEFT), helpers.table(spark, [(1, "p", "P", 1.0)], RIGHT)
    if streaming:
        a, b = helpers.as_stream(spark, a, tmp_path / "a"), helpers.as_stream(spark, b, tmp_path / "b")
    tables, join = (FlowTable(a), FlowTable(b)), JoinSpec("ta", "tb", "k", "key", "left", "a", "b")
    if how == "right":
        tables, join = tables[::-1], JoinSpec("tb", "ta", "key", "k", "right", "b", "a")
    out = join_windowed(*tables, join, ["a.v", "a.k", "b.w"], 10).df
    if streaming:
        later = helpers.table(spark, [(100, "z", -1)], LEFT), helpers.table(spark, [(100, "y", "Y", 0.0)], RIGHT)
        plan = out._jdf.queryExecution().analyzed().toString()
        assert "__ln" in plan and "__rn" in plan
        assert run_available(out, str(tmp_path / "run")).where("k is null").count() == 0  # the window is open
        for df, name in zip(later, "ab"):
            df.write.mode("append").parquet(str(tmp_path / name))
        out = run_available(out, str(tmp_path / "run"))
        got = [(r.v, r.k, r.w) for r in out.collect()]
    else:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        try:
            plan = out._jdf.queryExecution().executedPlan().toString()
            got = [(r.v, r.k, r.w) for r in out.collect()]
            parts = out.where("k is null").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.unset("spark.sql.adaptive.enabled")
        assert "__ln" in plan and "__rn" in plan
        assert sum(parts) == 200 and max(parts) < 120
    want = [(i, None if i % 2 else "p", None if i % 2 else "P") for i in range(400)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
