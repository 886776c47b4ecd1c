"""Outputs written to their tables and their storages in one query, and tables that several jobs read."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

import helpers
from rtflow import Job, build
from rtflow.operators import WindowSpec
from rtflow.plans.dataflow import job_order, shared_tables
from rtflow.streaming import Folder, build_once, fan_out, run_batch, start_materialised


def rows(spark, n=6):
    return helpers.table(spark, [(i, "ab"[i % 2], i) for i in range(n)], ["k string", "v bigint"])


def sums(storages=None, source="kept", output="sums", size=2):
    return Job(output, [source], ["k", "sum(v) as total"], WindowSpec("tumble", size=size), group_by=["k"], storages=storages)


def kept(storages=None):
    return Job("kept", ["t"], ["k", "v"], where="v > 0", storages=storages)


def texts(spark, path):
    return Counter(r.value for r in spark.read.text(str(path)).collect())


def test_a_batch_is_added_once_wherever_it_broke_off(spark, tmp_path, monkeypatch):
    df = spark.range(40).repartition(4)
    folder = Folder(spark, f"{tmp_path}/out", "one")
    # Broken off while its files are staged: what is there is written over.
    df.limit(3).write.parquet(f"{tmp_path}/out/_staged/{folder.tag}-7")
    (tmp_path / "out" / "_staged" / f"{folder.tag}-7" / "_SUCCESS").unlink()
    folder.add(df, "7", "parquet")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(40))
    # Run again, with other files for the same rows.
    folder.add(df.repartition(2), "7", "parquet")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40
    # Broken off between two of its files: the others follow, and none is written again.
    real = Folder.mark
    monkeypatch.setattr(Folder, "mark", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        folder.add(df, "8", "parquet")
    monkeypatch.setattr(Folder, "mark", real)
    moved = sorted((tmp_path / "out").glob(f"{folder.tag}-8-*"))
    staged = tmp_path / "out" / "_staged" / f"{folder.tag}-8"
    moved[-1].rename(staged / moved[-1].name.removeprefix(f"{folder.tag}-8-"))
    folder.add(spark.range(1000), "8", "parquet")
    assert Counter(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == Counter([*range(40)] * 2)
    assert sorted(r.id for r in folder.read("8", df.schema, "parquet").collect()) == list(range(40))
    assert folder.read("9", df.schema, "parquet").count() == 0
    # Another writer's batch of that number is another one.
    Folder(spark, f"{tmp_path}/out", "two").add(df, "7", "parquet")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 120


def test_a_replayed_batch_adds_no_record(spark, tmp_path):
    stream = helpers.as_stream(spark, rows(spark), tmp_path / "in")
    files = {"files": {"path": f"{tmp_path}/json"}}

    def run():
        query = fan_out(stream, f"{tmp_path}/table", files, {}, f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    want = texts(spark, tmp_path / "json")
    assert len(want) == 6 and spark.read.parquet(f"{tmp_path}/table").count() == 6
    # The checkpoint forgets that the batch was committed: Spark runs it again under its number.
    commits = list((tmp_path / "cp" / "commits").glob("[0-9]*"))
    assert commits
    for path in [*commits, *(tmp_path / "cp" / "commits").glob(".*.crc")]:
        path.unlink()
    run()
    assert texts(spark, tmp_path / "json") == want and spark.read.parquet(f"{tmp_path}/table").count() == 6
    rows(spark, 2).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sum(texts(spark, tmp_path / "json").values()) == 8


def test_topics_are_sent_once(spark, tmp_path, monkeypatch):
    from rtflow.streaming import sinks

    sent = []
    monkeypatch.setattr(sinks, "write_topic", lambda df, topic, *_: sent.append((topic, df.count())))
    servers = {"kafka.bootstrap.servers": "x:1"}
    for _ in range(2):
        sinks.store(rows(spark), {"kafka": {"topic": "q"}}, servers, "w", "0000000001", f"{tmp_path}/sent")
    sinks.store(rows(spark), {"kafka": {"topic": "q"}}, servers, "w", "0000000002", f"{tmp_path}/sent")
    assert sent == [("q", 6), ("q", 6)]


def test_storages_are_checked_before_anything_runs(spark, tmp_path):
    # A job without storages writes a topic of its name.
    with pytest.raises(ValueError, match="bootstrap"):
        run_batch(spark, {"t": rows(spark)}, [kept({}), sums()], f"{tmp_path}/b", storages=True)
    stream = helpers.as_stream(spark, rows(spark), tmp_path / "in")
    with pytest.raises(ValueError, match="bootstrap"):
        start_materialised(spark, {"t": stream}, [kept({}), sums()], f"{tmp_path}/s", True, storages=True)
    assert not (tmp_path / "b").exists() and not (tmp_path / "s").exists()
    with pytest.raises(ValueError, match="written"):
        start_materialised(spark, {"t": stream}, [kept()], f"{tmp_path}/s", True, written="some")


@pytest.mark.parametrize("mode", ["all", "shared", "batch"])
def test_tables_and_storages_hold_the_same_rows(spark, tmp_path, mode):
    jobs = [kept({"files": {"path": f"{tmp_path}/kept"}}), sums({"files": {"path": f"{tmp_path}/sums", "format": "parquet"}})]
    if mode == "batch":
        out = run_batch(spark, {"t": rows(spark)}, jobs, f"{tmp_path}/out", storages=True)
        paths = {name: f"{tmp_path}/out/{name}" for name in out}
    else:
        stream = helpers.as_stream(spark, rows(spark), tmp_path / "in")
        start_materialised(spark, {"t": stream}, jobs, f"{tmp_path}/out", True, written=mode, storages=True)
        paths = {job.output: f"{tmp_path}/out/tables/{job.output}" for job in jobs}
    table = spark.read.parquet(paths["kept"])
    assert sorted(json.loads(x)["v"] for x in texts(spark, tmp_path / "kept")) == sorted(r.v for r in table.collect()) == [1, 2, 3, 4, 5]
    same = [sorted(map(tuple, spark.read.parquet(x).collect())) for x in (paths["sums"], f"{tmp_path}/sums")]
    assert same[0] == same[1] and len(same[0]) == (5 if mode == "batch" else 1)


def test_which_tables_are_shared(spark):
    jobs = [kept(), sums(), sums(output="more", size=4), Job("chain", ["sums"], ["k", "max(total) as m"], WindowSpec("tumble", size=4), group_by=["k"])]
    order = job_order(jobs, ["t"])
    assert shared_tables(order) == {"kept", "sums"}
    assert shared_tables(order, ["more", "chain"]) == {"kept"}
    assert shared_tables(order, ["chain", "sums"]) == {"kept", "sums"}
    assert shared_tables(order[:1]) == set()
    with pytest.raises(ValueError, match="no job writes"):
        shared_tables(order, ["t"])


def test_a_source_is_scanned_once_by_each_job_that_reads_it(spark, tmp_path):
    rows(spark).write.parquet(f"{tmp_path}/in")
    source = helpers.with_event_time(spark.read.parquet(f"{tmp_path}/in")).withColumn("mark", F.lit(1))
    jobs = [kept(), sums(), sums(output="more", size=4)]
    names = ["kept", "sums", "more"]
    composed = build(spark, {"t": source}, jobs)
    once = build_once(spark, {"t": source}, jobs, f"{tmp_path}/work", names)
    for name in names:
        assert sorted(map(tuple, composed[name].df.collect()), key=repr) == sorted(map(tuple, once[name].df.collect()), key=repr)
        # Nothing that is asked for reads the source again: it reads the one table that was written.
        files = once[name].df.inputFiles()
        assert files and all("/work/kept/" in f for f in files)
    assert [p.name for p in (tmp_path / "work").iterdir()] == ["kept"]
    stream = helpers.as_stream(spark, rows(spark), tmp_path / "s")
    with pytest.raises(ValueError, match="start_materialised"):
        build_once(spark, {"t": stream}, jobs, f"{tmp_path}/x")


def test_shared_streams_run_a_query_for_each_table_with_several_readers(spark, tmp_path):
    stream = helpers.as_stream(spark, rows(spark, 12), tmp_path / "in")
    chain = Job("chain", ["sums"], ["k", "max(total) as m"], WindowSpec("tumble", size=4), group_by=["k"])
    jobs = [kept(), sums(), chain, sums(output="more", size=4)]
    queries = start_materialised(spark, {"t": stream}, jobs, f"{tmp_path}/out", True, written="shared")
    assert sorted(queries) == ["chain", "kept", "more"]
    fused = build(spark, {"t": rows(spark, 12)}, jobs)
    whole = {tuple(r) for r in fused["chain"].output.collect()}
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/tables/chain").collect()]
    assert got and set(got) < whole and len(set(got)) == len(got)
