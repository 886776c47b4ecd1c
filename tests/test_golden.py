"""The documented flows, run as streams over the documented inputs, give the documented outputs."""

import json
from collections import Counter

import pytest

import samples
from rtflow import build, load_jobs, load_tables
from rtflow.__main__ import main
from rtflow.streaming import encode_json, file_writer, run_available, run_batch, start, start_materialised


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    for name, lines in (("wb", samples.WEB_LOG), ("ip", samples.IP_STREAM)):
        (root / name).mkdir()
        (root / name / "part-0.json").write_text(lines, encoding="utf-8")
    (root / "table").mkdir()
    rows = [json.dumps({"id": i, "ip": ip, "city": city}) for i, ip, city in samples.IP_TABLE]
    (root / "table" / "part-0.json").write_text("\n".join(rows), encoding="utf-8")
    return root


def specs(inputs):
    return [
        {
            "table_id": "zc_source_wb",
            "table_type": "stream",
            "schema": samples.WEB_LOG_SCHEMA,
            "storages": {"files": {"path": str(inputs / "wb")}},
        },
        {
            "table_id": "zc_source_ip",
            "table_type": "stream",
            "schema": json.dumps(samples.IP_STREAM_SCHEMA),
            "storages": json.dumps({"files": {"path": str(inputs / "ip")}}),
        },
        {
            "table_id": "zc_table_ip",
            "table_type": "static",
            "schema": samples.IP_TABLE_SCHEMA,
            "storages": {"files": {"path": str(inputs / "table"), "format": "json"}},
        },
    ]


def multiset(records):
    return Counter(json.dumps(record, sort_keys=True, ensure_ascii=False) for record in records)


def json_records(df):
    return multiset(json.loads(row.value) for row in df.collect())


FLOWS = {
    "zc_stream1": samples.FLOW_1,
    "zc_stream2": samples.FLOW_1,
    "zc_stream3": samples.FLOW_1,
    "zc_stream_join4": samples.FLOW_2,
    "zc_stream_join5": samples.FLOW_2,
    "zc_stream_join6": samples.FLOW_2,
}


@pytest.mark.parametrize("output", FLOWS)
def test_stream(spark, inputs, output, tmp_path):
    tables = load_tables(spark, specs(inputs))
    flow = build(spark, tables, load_jobs(spark, FLOWS[output]), null_fill="text")
    written = run_available(flow[output].df, str(tmp_path), fmt="json")
    assert json_records(written) == multiset(samples.GOLDEN[output])


def test_fused_queries_write_json(spark, inputs, tmp_path):
    tables = load_tables(spark, specs(inputs))
    flow = build(spark, tables, load_jobs(spark, samples.FLOW_1))
    queries = start(flow, lambda name, df: file_writer(df, f"{tmp_path}/{name}"), f"{tmp_path}/cp", available_now=True)
    for name, query in queries.items():
        query.awaitTermination()
        assert json_records(spark.read.text(f"{tmp_path}/{name}")) == multiset(samples.GOLDEN[name])


@pytest.mark.parametrize("flow", ["FLOW_1", "FLOW_2"])
def test_materialised(spark, inputs, flow, tmp_path):
    jobs = load_jobs(spark, getattr(samples, flow))
    tables = load_tables(spark, specs(inputs))
    start_materialised(spark, tables, jobs, str(tmp_path), available_now=True, null_fill="text")
    for job in jobs:
        got = json_records(encode_json(spark.read.parquet(f"{tmp_path}/tables/{job.output}")))
        want = multiset(samples.GOLDEN[job.output])
        if job.output == "zc_stream_join6":
            # One watermark delay later per job: an open window may stay open, none may differ.
            assert got <= want and got
        else:
            assert got == want


@pytest.mark.parametrize("flow", ["FLOW_1", "FLOW_2"])
def test_batch_has_the_stream_rows_and_the_open_windows(spark, inputs, flow, tmp_path):
    jobs = load_jobs(spark, getattr(samples, flow))
    tables = load_tables(spark, specs(inputs), streaming=False)
    written = run_batch(spark, tables, jobs, str(tmp_path), null_fill="text")
    built = build(spark, tables, jobs, null_fill="text")
    for job in jobs:
        got = json_records(encode_json(written[job.output]))
        assert got == json_records(encode_json(built[job.output].df))
        assert multiset(samples.GOLDEN[job.output]) <= got


def test_jobs_7_and_8(spark, inputs, tmp_path):
    tables = load_tables(spark, specs(inputs))
    flow = build(spark, tables, load_jobs(spark, samples.FLOW_3))
    written = run_available(flow["zc_stream8"].df, str(tmp_path), fmt="json")
    # methods per window [10,20) [20,30) [30,40): counted in the window after
    closed = {(20, 30): 3, (30, 40): 5}
    want = [
        {
            "event_time": samples.at(end),
            "window_start": samples.at(start),
            "window_end": samples.at(end),
            "my_count": count,
        }
        for (start, end), count in closed.items()
    ]
    assert json_records(written) == multiset(want)


@pytest.mark.parametrize("mode", ["fused", "shared", "materialised", "batch"])
def test_command_line(spark, inputs, mode, tmp_path):
    jobs = [dict(record) for record in samples.FLOW_1]
    jobs[0]["storages"] = {}
    for record in jobs[1:]:
        record["storages"] = {"files": {"path": f"{tmp_path}/out/{record['output_table']}"}}
    (tmp_path / "tables.json").write_text(json.dumps(specs(inputs)), encoding="utf-8")
    (tmp_path / "jobs.json").write_text(json.dumps(jobs), encoding="utf-8")
    command = ["--tables", f"{tmp_path}/tables.json", "--jobs", f"{tmp_path}/jobs.json", "--mode", mode]
    main([*command, "--directory", f"{tmp_path}/work", "--available-now"])
    assert not (tmp_path / "out" / "zc_stream1").exists()
    for name in ("zc_stream2", "zc_stream3"):
        got, want = json_records(spark.read.text(f"{tmp_path}/out/{name}")), multiset(samples.GOLDEN[name])
        assert want <= got if mode == "batch" else want == got
    if mode in ("materialised", "batch"):
        table = f"{tmp_path}/work/{'tables/' if mode == 'materialised' else ''}zc_stream2"
        got = json_records(encode_json(spark.read.parquet(table)))
        assert multiset(samples.GOLDEN["zc_stream2"]) <= got
