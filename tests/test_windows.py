import random
import re

import pytest

import helpers
from rtflow import FlowTable, WindowSpec, project, window_aggregate
from rtflow.operators import batch_windows
from rtflow.streaming import run_available

COLUMNS = ("k string", "v bigint")


def random_rows(seed, n=200, span=400, keys=("a", "b", None)):
    rng = random.Random(seed)
    rows = [(rng.randrange(-span, span * 4) / 4, rng.choice(keys), rng.randrange(100)) for _ in range(n)]
    return [*rows, (None, "a", 1), (float(-span), "edge", 5), (float(span), "edge", 5)]


PLAIN = ["k", "sum(v) as total", "count(*) as n", "avg(v) as mean", "min(v) as low", "max(v) as top"]
MODEL = {
    "total": sum,
    "n": len,
    "mean": lambda values: sum(values) / len(values),
    "low": min,
    "top": max,
}
OTHER = ["k", "count(distinct v) as n_values", "max(v) - min(v) as spread"]
OTHER_MODEL = {"n_values": lambda values: len(set(values)), "spread": lambda values: max(values) - min(values)}


def expected(windows, size, model):
    return sorted(
        ((start + size, key, *[function(values) for function in model.values()]) for (start, key), values in windows.items()),
        key=repr,
    )


@pytest.mark.parametrize("size,step", [(10, 10), (10, 5), (10, 3), (12, 8), (10, 15), (7, 20), (9, 1), (50, 1), (64, 1), (100, 3), (144, 1), (700, 9)])
@pytest.mark.parametrize("select,model", [(PLAIN, MODEL), (OTHER, OTHER_MODEL)])
def test_windows_against_model(spark, size, step, select, model):
    rows = random_rows(size * 31 + step)
    window = WindowSpec("tumble", size=size) if size == step else WindowSpec("slide", size=size, slide=step)
    table = FlowTable(helpers.table(spark, rows, COLUMNS))
    got = window_aggregate(table, window, select, ["k"]).df
    assert helpers.result(got, "k", *model) == expected(helpers.sliding(rows, size, step), size, model)
    for row in got.collect():
        end = helpers.micros(row.event_time) // 1_000_000
        assert (row.window_start, row.window_end) == (helpers.utc_text(end - size), helpers.utc_text(end))


@pytest.mark.parametrize("gap", [1, 3, 17])
@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("select,model", [(PLAIN, MODEL), (OTHER, OTHER_MODEL)])
def test_sessions_against_model(spark, monkeypatch, gap, keyed, select, model):
    monkeypatch.setattr(batch_windows, "SESSION_BLOCK", 3)  # many block borders
    rows = random_rows(gap, n=150)
    table = FlowTable(helpers.table(spark, rows, COLUMNS))
    window = WindowSpec("session", gap=gap)
    if keyed:
        got = window_aggregate(table, window, select, ["k"]).df.withColumnRenamed("k", "key")
    else:
        got = window_aggregate(table, window, select[1:]).df.selectExpr("*", "'' as key")
        rows = [(time, "", value) for time, _, value in rows]
    found = helpers.sessions(rows, gap)
    want = sorted(
        ((end, key, helpers.utc_text(start), *[f(values) for f in model.values()]) for (start, end, key), values in found.items()),
        key=repr,
    )
    assert helpers.result(got, "key", "window_start", *model) == want


def test_rows_a_gap_apart_share_a_session(spark):
    rows = [(0, "a", 1), (10, "a", 1), (20.000001, "a", 1), (30.000001, "b", 1)]
    table = FlowTable(helpers.table(spark, rows, COLUMNS))
    got = window_aggregate(table, WindowSpec("session", gap=10), ["k", "count(*) as n"], ["k"]).df
    assert helpers.result(got, "k", "n") == [(20.0, "a", 2), (30.000001, "a", 1), (40.000001, "b", 1)]


def test_keys_need_not_be_selected_and_keys_alone_will_do(spark):
    rows = [(1, "a", 1), (2, "b", 2), (3, "a", 3)]
    table = FlowTable(helpers.table(spark, rows, COLUMNS))
    window = WindowSpec("tumble", size=10)
    assert helpers.result(window_aggregate(table, window, ["max(v) as top"], ["k"]).df, "top") == [(10.0, 2), (10.0, 3)]
    assert helpers.result(window_aggregate(table, window, ["k"], ["k"]).df, "k") == [(10.0, "a"), (10.0, "b")]
    upper = window_aggregate(table, window, ["upper(k) as u", "sum(v) as s"], ["k"]).df
    assert helpers.result(upper, "u", "s") == [(10.0, "A", 4), (10.0, "B", 2)]


def test_projection_time_columns_and_offset(spark):
    table = FlowTable(helpers.table(spark, [(60, "a", 1), (None, "b", 2)], COLUMNS))
    rows = project(table, ["k", "v * 2 as twice"], "v < 5", offset_hours=8).df.orderBy("k").collect()
    assert rows[0][1:] == ("1970-01-01 08:01:00", "1970-01-01 08:01:00", "a", 2)
    assert rows[1][:3] == (None, None, None)


@pytest.mark.parametrize(
    "window",
    [
        WindowSpec("tumble", size=7),
        WindowSpec("slide", size=10, slide=4),
        WindowSpec("slide", size=12, slide=2),
        WindowSpec("slide", size=5, slide=9),
        WindowSpec("session", gap=3),
    ],
    ids=lambda window: window.kind + str(window.slide or ""),
)
def test_stream_is_batch_up_to_the_watermark(spark, tmp_path, window):
    rows = [row for row in random_rows(3, span=60) if row[0] is None or row[0] >= 0]
    df = helpers.table(spark, rows, COLUMNS)
    batch = helpers.result(window_aggregate(FlowTable(df), window, PLAIN, ["k"]).df, "k", *MODEL)
    stream = FlowTable(helpers.as_stream(spark, df, tmp_path / "in"))
    got = run_available(window_aggregate(stream, window, PLAIN, ["k"]).df, str(tmp_path / "run"))
    watermark = max(row[0] for row in rows if row[0] is not None) - 2
    assert helpers.result(got, "k", *MODEL) == [row for row in batch if row[0] <= watermark]


def test_three_chained_windows_with_a_row_on_every_edge(spark, tmp_path):
    rows = [(time, "a", time) for time in range(0, 200, 2)] + [(time, "b", 1) for time in range(0, 200, 5)]
    df = helpers.table(spark, rows, COLUMNS)

    def chain(df):
        first = window_aggregate(FlowTable(df), WindowSpec("tumble", size=4), ["k", "sum(v) as v"], ["k"])
        second = window_aggregate(first, WindowSpec("slide", size=8, slide=12), ["k", "sum(v) as v"], ["k"])
        third = window_aggregate(second, WindowSpec("session", gap=6), ["k", "count(*) as n"], ["k"])
        return window_aggregate(third, WindowSpec("tumble", size=60), ["sum(n) as n", "count(*) as m"])

    batch = helpers.result(chain(df).df, "n", "m")
    stream = chain(helpers.as_stream(spark, df, tmp_path / "in"))
    assert stream.depth == 4
    got = run_available(stream.df, str(tmp_path / "run"))
    assert helpers.result(got, "n", "m") == [row for row in batch if row[0] <= 196]
    assert got.count()


def test_distinct_counts_on_streams(spark, tmp_path):
    stream = FlowTable(helpers.as_stream(spark, helpers.table(spark, [(1, "a", 1)], COLUMNS), tmp_path))
    for window, select in (
        (WindowSpec("session", gap=3), ["count(distinct v) as n"]),
        (WindowSpec("tumble", size=3), ["count(distinct v) as n", "count(distinct k) as m"]),
        (WindowSpec("tumble", size=3), ["count(distinct v) as n", "collect_list(k) as ks"]),
    ):
        with pytest.raises(ValueError, match="approx_count_distinct"):
            window_aggregate(stream, window, select)


def test_distinct_counts_next_to_merged_states_on_streams(spark, tmp_path):
    rows = random_rows(6, span=40, keys=("a", "b", "c"))
    df = helpers.table(spark, [row for row in rows if row[0] is None or row[0] >= 0], COLUMNS)
    select = ["count(distinct v) as n", "sort_array(collect_set(k)) as ks", "round(stddev(v), 6) as d", "max_by(k, v) as top"]
    window = WindowSpec("tumble", size=6)
    batch = helpers.result(window_aggregate(FlowTable(df), window, select[:3]).df, "n", "ks", "d")
    stream = FlowTable(helpers.as_stream(spark, df, tmp_path / "in"))
    got = run_available(window_aggregate(stream, window, select).df, str(tmp_path / "run"))
    found = helpers.result(got, "n", "ks", "d")
    assert len(found) > 3 and all(row in batch for row in found)


def test_distinct_counts_with_having_on_streams(spark, tmp_path):
    rows = random_rows(5, span=60, keys=("a", "b", "c"))
    df = helpers.table(spark, [row for row in rows if row[0] is None or row[0] >= 0], COLUMNS)
    window, select = WindowSpec("slide", size=12, slide=4), ["k", "count(distinct v) + 1 as n"]
    having = "count(distinct v) > 3 and k <> 'b' and max(v) > 50"
    batch = helpers.result(window_aggregate(FlowTable(df), window, select, ["k"], having=having).df, "k", "n")
    stream = FlowTable(helpers.as_stream(spark, df, tmp_path / "in"))
    got = run_available(window_aggregate(stream, window, select, ["k"], having=having).df, str(tmp_path / "run"))
    found = helpers.result(got, "k", "n")
    assert found and found == [row for row in batch if row[0] <= found[-1][0] or row in found]


WINDOWS = [
    WindowSpec("tumble", size=10),
    WindowSpec("slide", size=12, slide=4),
    WindowSpec("slide", size=100, slide=3),
    WindowSpec("slide", size=5, slide=9),
    WindowSpec("session", gap=7),
]


def test_types_and_results_do_not_depend_on_the_plan(spark):
    df = helpers.table(spark, random_rows(8), COLUMNS).selectExpr("event_time", "k", "v", "cast(v / 7 as decimal(10,2)) as d")
    select = ["k", "sum(d) as s", "avg(d) as m", "max(v) - min(v) as spread", "sum(if(k = 'a, (', 1, 2)) as q"]
    kinds = set()
    for window in WINDOWS:
        for having in (None, "count(*) > 0 and (k = 'a' or k is null or sum(d) is not null)"):
            split = window_aggregate(FlowTable(df), window, select, ["k"], having=having).df
            # a list is no plain aggregate, so these are computed in one phase
            whole = window_aggregate(FlowTable(df), window, [*select, "collect_list(v) as l"], ["k"], having=having).df
            kinds |= {str(split.dtypes), str(whole.drop("l").dtypes)}
            names = ("k", "window_start", "s", "m", "spread", "q")
            assert helpers.result(split, *names) == helpers.result(whole, *names)
    assert len(kinds) == 1


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("select", [["count(*) as n"], ["count(distinct v) as n", "max(v) - min(v) as w"]])
def test_no_step_of_sessions_has_a_whole_key(spark, keyed, select):
    df = helpers.table(spark, random_rows(9), COLUMNS)
    out = window_aggregate(FlowTable(df), WindowSpec("session", gap=3), select, ["k"] if keyed else [], having="count(*) > 1").df
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window [" not in plan


def test_having_keeps_panes(spark):
    df = helpers.table(spark, random_rows(10), COLUMNS)
    window = WindowSpec("slide", size=60, slide=4)
    out = window_aggregate(FlowTable(df), window, ["k", "sum(v) / count(*) as r"], ["k"], having="sum(v) > 10 or k = 'a'").df
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate [") > plan.index("Generate explode") > plan.index("Aggregate [")


def test_panes_of_many_windows_are_copied_a_few_times(spark, tmp_path):
    """A row a second: levels hold a pane at each slide, and none is copied more than ``RADIX`` times."""
    rows = [(float(t), "a", t % 10) for t in range(4000)]
    helpers.table(spark, rows, COLUMNS).write.parquet(str(tmp_path / "t"))
    table = FlowTable(spark.read.parquet(str(tmp_path / "t")))
    out = window_aggregate(table, WindowSpec("slide", size=514, slide=1), ["k", "sum(v) as v", "count(*) as n"], ["k"]).df
    got = {r.window_end: (r.v, r.n) for r in out.collect()}
    assert len(got) == 4513
    for end in (1, 8, 513, 514, 2000, 4000, 4513):
        inside = [r[2] for r in rows if end - 514 <= r[0] < end]
        assert got[helpers.utc_text(end)] == (sum(inside), len(inside))
    steps = re.findall(r"Generate explode\(sequence\((.*)", out._jdf.queryExecution().optimizedPlan().toString())
    assert steps and len(steps) < 20
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert final.count("Scan parquet") == 1 and "ReusedExchange" in final


@pytest.mark.parametrize(
    "kind,sizes",
    [
        ("hop", {}),
        ("tumble", {}),
        ("tumble", {"size": 0}),
        ("tumble", {"size": 1.5}),
        ("slide", {"size": 10}),
        ("slide", {"size": 10, "slide": -1}),
        ("session", {"gap": None}),
    ],
)
def test_bad_windows(kind, sizes):
    with pytest.raises(ValueError):
        WindowSpec(kind, **sizes)
