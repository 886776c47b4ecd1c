"""Static tables that are read once for all micro-batches, and anew when refreshed."""

import json
import time
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rtflow import build, load_jobs
from rtflow.__main__ import main
from rtflow.sources import load_tables
from rtflow.streaming import StaticTables, configure
from samples import job

TIME = {"field_name": "event_time", "field_type": "TIMESTAMP"}
KEY, NAME = {"field_name": "k", "field_type": "LONG"}, {"field_name": "name", "field_type": "STRING"}
JOIN = "select e.k, s.name from e left join s on e.k = s.k"


def specs(directory):
    (directory / "e").mkdir()
    files = lambda name, fmt: {"files": {"path": str(directory / name), "format": fmt}}
    return [
        {"table_id": "e", "table_type": "stream", "schema": [TIME, KEY], "storages": files("e", "json")},
        {"table_id": "s", "table_type": "static", "schema": [KEY, NAME], "storages": files("s", "parquet")},
    ]


def names(directory, *rows):
    """Replace the files of the table, past Spark, which would read anew what this session overwrites."""
    (directory / "s").mkdir(exist_ok=True)
    for old in list((directory / "s").iterdir()):
        old.unlink()
    schema = pa.schema([("k", pa.int64()), ("name", pa.string())])
    table = pa.Table.from_pylist([dict(zip(("k", "name"), row)) for row in rows], schema)
    pq.write_table(table, directory / "s" / f"{uuid.uuid4().hex}.parquet")


def event(directory, number, k):
    row = {"event_time": "2024-01-01 00:00:00", "k": k}
    (directory / "e" / str(number)).write_text(json.dumps(row), encoding="utf-8")


def started(spark, directory, tables):
    flow = build(spark, tables, load_jobs(spark, job("o", ["e", "s"], JOIN)))
    name = f"statics_{directory.name}"
    writer = flow["o"].output.writeStream.format("memory").queryName(name).option("checkpointLocation", str(directory / "run"))
    return writer.start(), lambda: sorted((r.k, r.name) for r in spark.table(name).collect())


def test_files_are_read_once_and_again_when_refreshed(spark, tmp_path):
    configure(spark)
    records = specs(tmp_path)
    names(tmp_path, (1, "a"), (2, "b"))
    tables = load_tables(spark, records)
    with StaticTables(spark, tables, records) as statics:
        query, rows = started(spark, tmp_path, tables)
        try:
            event(tmp_path, 0, 1)
            query.processAllAvailable()
            names(tmp_path, (1, "c"), (2, "d"), (3, "e"))  # the files that were read are gone
            event(tmp_path, 1, 2)
            query.processAllAvailable()
            assert rows() == [(1, "a"), (2, "b")]
            statics.refresh()
            event(tmp_path, 2, 3)
            event(tmp_path, 3, 1)
            query.processAllAvailable()
            assert rows() == [(1, "a"), (1, "c"), (2, "b"), (3, "e")]
            names(tmp_path, (1, "f"))
            event(tmp_path, 4, 1)
            query.processAllAvailable()
            assert rows() == [(1, "a"), (1, "c"), (1, "c"), (2, "b"), (3, "e")]
        finally:
            query.stop()
    assert not tables["s"].df.storageLevel.useMemory


def test_refreshed_at_an_interval(spark, tmp_path):
    configure(spark)
    records = specs(tmp_path)
    names(tmp_path, (1, "a"))
    tables = load_tables(spark, records)
    with StaticTables(spark, tables, records, refresh=0.5) as statics:
        query, rows = started(spark, tmp_path, tables)
        try:
            event(tmp_path, 0, 1)
            query.processAllAvailable()
            names(tmp_path, (1, "b"))
            before, end = statics.refreshed, time.time() + 60
            while statics.refreshed < before + 2 and time.time() < end:
                time.sleep(0.1)
            event(tmp_path, 1, 1)
            query.processAllAvailable()
            assert rows() == [(1, "a"), (1, "b")]
        finally:
            query.stop()


def test_tables_without_files_are_read_anew(spark, tmp_path):
    source = tmp_path / "s"
    names(tmp_path, (1, "a"))
    records = specs(tmp_path)
    tables = load_tables(spark, records)
    with StaticTables(spark, tables) as statics:  # no specs: the plan runs again, over the files it knows
        assert tables["s"].df.count() == 1 and tables["s"].df.storageLevel.useMemory
        statics.refresh()
        assert tables["s"].df.storageLevel.useMemory and tables["s"].df.count() == 1
    assert source.exists()
    with pytest.raises(ValueError, match="positive"):
        StaticTables(spark, tables, refresh=0)


@pytest.mark.parametrize("mode", ["fused", "materialised"])
def test_command_line(spark, tmp_path, mode):
    records = specs(tmp_path)
    names(tmp_path, (1, "a"))
    event(tmp_path, 0, 1)
    event(tmp_path, 1, 2)
    one = job("o", ["e", "s"], JOIN)
    one["storages"] = {"files": {"path": str(tmp_path / "out"), "format": "json"}}
    for name, content in (("tables", records), ("jobs", [one])):
        (tmp_path / name).write_text(json.dumps(content), encoding="utf-8")
    main(["--tables", str(tmp_path / "tables"), "--jobs", str(tmp_path / "jobs"), "--directory", str(tmp_path / "d"),
          "--mode", mode, "--available-now", "--refresh-static", "60"])
    got = sorted((json.loads(r.value)["k"], json.loads(r.value)["name"]) for r in spark.read.text(str(tmp_path / "out")).collect())
    assert got == [(1, "a"), (2, "NULL")]
