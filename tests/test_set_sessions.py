"""Sessions of streams that collect sets, which are found in chunks of rows first."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

import helpers
from samples import utc
from rtflow import FlowTable, WindowSpec, window_aggregate
from rtflow.operators import stream_sessions
from rtflow.schema import to_struct
from rtflow.sources import stream_files, with_event_time
from rtflow.streaming import run_available

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
COLUMNS = ("k string", "v bigint")
SELECT = ["k", "count(*) as n", "sum(v) as total", "min_by(v, v) as low", "sort_array(collect_set(v)) as vs"]
NAMES = ["k", "n", "total", "low", "vs"]


@pytest.fixture
def chunks(request, spark, monkeypatch):
    """Chunks of so many rows, 7 unless told otherwise."""
    monkeypatch.setattr(stream_sessions, "CHUNK_ROWS", 1)
    spark.conf.set(BATCH, getattr(request, "param", 7))
    yield
    spark.conf.unset(BATCH)


def random_rows(seed, keys=("a", "b", "", None)):
    rng = random.Random(seed)
    rows = [(rng.randrange(1600) / 4, rng.choice(keys), rng.choice((None, *range(9)))) for _ in range(150)]
    # Times of 0 on both sides of a row without a time, and rows that are just a gap apart.
    return [*rows, (None, "a", 77), (None, None, 78), (0, "c", 1), (5, "c", 2), (10.000001, "c", 3), (900, "z", 1)]


def streamed(spark, df, directory, select, keys, gap=5, **how):
    stream = FlowTable(helpers.as_stream(spark, df.coalesce(2), directory / "in"))
    return run_available(window_aggregate(stream, WindowSpec("session", gap=gap), select, keys, **how).df, str(directory / "run"))


def test_a_session_of_many_values_takes_linear_time(spark, tmp_path):
    n = 500_000
    rows = spark.range(n).select((F.col("id") * 1000 + 1).alias("__m"), "id").unionByName(
        spark.range(1).select(F.lit(10**12).alias("__m"), "id")
    )
    df = with_event_time(rows.select(F.timestamp_micros("__m").alias("event_time"), F.lit("a").alias("k"), "id"))
    begun = time.time()
    got = streamed(spark, df.coalesce(1), tmp_path, ["k", "count(*) as n", "size(collect_set(id)) as ids"], ["k"])
    assert [row[1:] for row in helpers.result(got, "k", "n", "ids")] == [("a", n, n)]
    assert time.time() - begun < 60  # 3 minutes and more with a set merged for each row


@pytest.mark.parametrize("chunks,gap", [(1, 5), (7, 1), (7, 40), (10_000, 5)], indirect=["chunks"])
def test_sessions_with_sets_against_model(spark, tmp_path, chunks, gap):
    rows = random_rows(gap)
    got = streamed(spark, helpers.table(spark, rows, COLUMNS), tmp_path, SELECT, ["k"], gap)
    want = []
    for (_, end, key), values in helpers.sessions(rows, gap).items():
        known = sorted(v for v in values if v is not None)
        if end <= 898:
            want.append((end, key, len(values), sum(known) if known else None, known[0] if known else None, sorted(set(known))))
    assert helpers.result(got, *NAMES) == sorted(want, key=repr)


def test_sessions_with_sets_and_having_or_without_keys(spark, tmp_path, chunks):
    df = helpers.table(spark, random_rows(2), COLUMNS)
    for i, (select, keys, having) in enumerate((
        (SELECT, ["k"], "size(collect_set(v)) > 1 and k <> 'b'"),
        (["upper(k) as k", *SELECT[1:]], ["upper(k)", "v % 2"], "count(*) > 1"),
        (["'' as k", *SELECT[1:]], [], None),
    )):
        batch = window_aggregate(FlowTable(df), WindowSpec("session", gap=5), select, keys, having=having).df
        got = streamed(spark, df, tmp_path / str(i), select, keys, having=having)
        assert helpers.result(got, *NAMES) == [row for row in helpers.result(batch, *NAMES) if row[0] <= 898]
        assert got.count() > 3


def test_keys_of_other_types(spark, tmp_path, chunks):
    df = helpers.table(spark, random_rows(3, keys=("1", "2", None)), COLUMNS).withColumn("k", F.expr("try_cast(k as int)"))
    text = "case k when 1 then 'nan' when 2 then '-0' else cast(v as string) end"
    simple = [
        "k", "k > 1", "cast(k as decimal(20,3)) / 8", f"cast({text} as double)", f"cast({text} as float)", f"encode({text}, 'utf-8')",
        "date_add(date'2024-01-01', k)", "timestamp_seconds(k)", "cast(timestamp_seconds(k) as timestamp_ntz)", "cast(v as smallint)",
    ]
    select = ["max(k) as k", *SELECT[1:]]
    for i, keys in enumerate((simple[:3], simple[3:], ["struct(k, v % 2)", "array(k)"])):
        batch = window_aggregate(FlowTable(df), WindowSpec("session", gap=20), select, keys).df
        got = streamed(spark, df, tmp_path / str(i), select, keys, 20)
        assert helpers.result(got, *NAMES) == [row for row in helpers.result(batch, *NAMES) if row[0] <= 898]
        assert got.count()


def test_far_times(spark):
    """Distances beyond 63 bits are no short ones."""
    rows = [(-(2**63), "a"), (2**63 - 1, "a"), (2**63 - 11, "a"), (0, "a"), (None, "a"), (4, "b"), (9, "a")]
    df = spark.createDataFrame(rows, "t bigint, k string").coalesce(1)
    found = df.select("t", "k", stream_sessions._finder(10)("t", "k").alias("s")).collect()
    spans = {(row.t, row.k): row.s and tuple(row.s) for row in found}
    assert spans[-(2**63), "a"] == (-(2**63),) * 2 and spans[None, "a"] is None and spans[4, "b"] == (4, 4)
    assert spans[0, "a"] == spans[9, "a"] == (0, 9)
    assert spans[2**63 - 11, "a"] == (2**63 - 11,) * 2  # just a gap before the last, which Spark joins


def test_chained_sessions_with_sets(spark, tmp_path, chunks):
    df = helpers.table(spark, random_rows(4), COLUMNS)

    def chain(df):
        first = window_aggregate(FlowTable(df), WindowSpec("tumble", size=2), ["k", "max(v) as v"], ["k"])
        second = window_aggregate(first, WindowSpec("session", gap=5), SELECT, ["k"])
        return window_aggregate(second, WindowSpec("tumble", size=60), ["k", "sum(size(vs)) as vs", "count(*) as n"], ["k"])

    batch = helpers.result(chain(df).df, "k", "vs", "n")
    got = run_available(chain(helpers.as_stream(spark, df, tmp_path / "in")).df, str(tmp_path / "run"))
    assert helpers.result(got, "k", "vs", "n") == [row for row in batch if row[0] <= 898]
    assert got.count() > 3


def test_late_rows_of_sessions_with_sets(spark, tmp_path, chunks):
    """They count where they do in sessions without sets."""
    (tmp_path / "in").mkdir()
    files = [(1, 4), (3, 30), (8, 31), (2, 33, 29, 7), (60,), (36, 41, 20), (90,)]
    for i, times in enumerate(files):
        path = tmp_path / "in" / f"{i}.json"
        path.write_text("\n".join(json.dumps({"event_time": utc(t)}) for t in times), encoding="utf-8")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    schema = to_struct([{"field_name": "event_time", "field_type": "TIMESTAMP"}])
    results = []
    for name, select in (("plain", ["count(*) as n"]), ("sets", ["count(*) as n", "size(collect_set(event_time)) as m"])):
        stream = FlowTable(stream_files(spark, str(tmp_path / "in"), schema, "json", {"maxFilesPerTrigger": 1}))
        got = run_available(window_aggregate(stream, WindowSpec("session", gap=5), select).df, str(tmp_path / name))
        results.append(helpers.result(got, "window_start", "n"))
        if name == "sets":
            assert helpers.result(got, "n") == helpers.result(got, "m")
    assert results[0] == results[1] and sum(row[2] for row in results[0]) < sum(map(len, files)) - 1


def test_only_what_gains_is_found_in_chunks(spark, tmp_path):
    df = helpers.table(spark, random_rows(5), COLUMNS)
    stream = helpers.as_stream(spark, df, tmp_path)

    def plan(*select, window=WindowSpec("session", gap=5)):
        return window_aggregate(FlowTable(stream), window, select, ["k"]).df._jdf.queryExecution().analyzed().toString()

    assert "found(" in plan("collect_set(v) as vs") and "found(" in plan("sum(v) / size(COLLECT_SET (v)) as x")
    assert "found(" not in plan("collect_set(v) as vs", window=WindowSpec("tumble", size=5))
    assert "found(" not in plan("sum(v) as v")
    assert "found(" not in plan("collect_set(v) as vs", "collect_list(v) as all")  # a list keeps the order of its rows
    key = stream_sessions._LOCAL_MERGE
    spark.conf.set(key, "false")
    try:
        assert "found(" not in plan("collect_set(v) as vs")
    finally:
        spark.conf.set(key, "true")
