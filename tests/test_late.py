import json
import os

import pytest

import helpers
from samples import job, utc
from rtflow import build, load_jobs
from rtflow.schema import to_struct
from rtflow.sources import stream_files
from rtflow.streaming import configure, run_available

SCHEMA = to_struct([{"field_name": "event_time", "field_type": "TIMESTAMP"}])


@pytest.mark.parametrize(
    "files,first_window",
    [
        # the late row comes two files after the jump to :30 that closes its window
        ([(1, 5), (30,), (31,), (2, 33), (60,)], 2),
        # it comes in the very next file, which the watermark of the jump does not filter yet
        ([(1, 5), (30,), (2, 31), (33,), (60,)], 3),
    ],
)
def test_late_rows(spark, tmp_path, files, first_window):
    directory = tmp_path / "in"
    directory.mkdir()
    for i, times in enumerate(files):
        path = directory / f"{i}.json"
        path.write_text("\n".join(json.dumps({"event_time": utc(t)}) for t in times), encoding="utf-8")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = stream_files(spark, str(directory), SCHEMA, "json", {"maxFilesPerTrigger": 1})
    jobs = load_jobs(spark, job("o", ["t"], "select count(*) as n from t", window="tumble", size=10))
    got = run_available(build(spark, {"t": stream}, jobs)["o"].df, str(tmp_path / "run"))
    assert helpers.result(got, "n") == [(10.0, first_window), (40.0, 3)]


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    directory = tmp_path / "in"
    directory.mkdir()
    jobs = load_jobs(spark, job("o", ["t"], "select count(*) as n from t", window="tumble", size=10))

    def run(name, *times):
        (directory / name).write_text("\n".join(json.dumps({"event_time": utc(t)}) for t in times), encoding="utf-8")
        stream = stream_files(spark, str(directory), SCHEMA, "json")
        return helpers.result(run_available(build(spark, {"t": stream}, jobs)["o"].df, str(tmp_path / "run")), "n")

    assert run("a", 1, 2, 13) == [(10.0, 2)]
    assert run("b", 14, 25) == [(10.0, 2), (20.0, 2)]


@pytest.mark.parametrize("slide", [8, 6, 4, 3, 1])
@pytest.mark.parametrize("having", ["", " having count(*) > 0"])
def test_late_rows_count_in_all_open_windows(spark, tmp_path, slide, having):
    """A late row counts in those of its windows that the watermark has not passed, at every ratio."""
    size = 12
    directory = tmp_path / "in"
    directory.mkdir()
    times = (1, 9, 10, 5, 60, 61)
    for i, time in enumerate(times):
        path = directory / f"{i}.json"
        path.write_text(json.dumps({"event_time": utc(time)}), encoding="utf-8")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = stream_files(spark, str(directory), SCHEMA, "json", {"maxFilesPerTrigger": 1})
    sql = "select count(*) as n from t" + having
    jobs = load_jobs(spark, job("o", ["t"], sql, window="slide", size=size, slide=slide))
    got = run_available(build(spark, {"t": stream}, jobs)["o"].df, str(tmp_path / "run"))
    # When 5 comes, the watermark is two seconds before 10 at most, and it has passed no window of 5.
    ends = range(-size, 80)
    want = {}
    for end in (e for e in ends if (e - size) % slide == 0 and e <= 58):
        n = sum(end - size <= t < end for t in (1, 9, 10, 60)) + (end > 7 and end - size <= 5 < end)
        if n:
            want[float(end)] = n
    assert dict(helpers.result(got, "n")) == want


def test_configure_leaves_the_number_of_partitions(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        for chosen in ("200", "7"):
            spark.conf.set(key, chosen)
            configure(spark, rocksdb=False)
            assert spark.conf.get(key) == chosen
        configure(spark, rocksdb=False, state_partitions=5)
        assert spark.conf.get(key) == "5"
        with pytest.raises(ValueError):
            configure(spark, state_partitions=0)
    finally:
        spark.conf.set(key, before)
