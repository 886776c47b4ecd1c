"""Run a data flow from its configuration files: ``spark-submit ... -m rtflow`` or ``python -m rtflow``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from rtflow.plans import build, load_jobs
from rtflow.sources import WATERMARK_DELAY, load_tables
from rtflow.streaming import StaticTables, configure, configured_sinks, run_batch, start, start_materialised


def _options(pairs: list[str]) -> dict[str, str]:
    return dict(pair.split("=", 1) for pair in pairs)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rtflow", description=__doc__)
    parser.add_argument("--tables", required=True, help="JSON file: a list of table specs")
    parser.add_argument("--jobs", required=True, help="JSON file: a job or a list of jobs")
    parser.add_argument("--directory", required=True, help="shared folder for checkpoints and written tables")
    parser.add_argument("--mode", choices=("fused", "shared", "materialised", "batch"), default="fused")
    parser.add_argument("--available-now", action="store_true", help="stop at the end of the present input")
    parser.add_argument("--null-fill", choices=("sql", "text"), default="text")
    parser.add_argument("--join-salt", type=int, default=1)
    parser.add_argument("--offset-hours", type=int, default=0, help="move times written as text by these hours")
    parser.add_argument("--watermark", default=WATERMARK_DELAY)
    parser.add_argument("--idle", metavar="INTERVAL", help="let the watermark of silent inputs follow the clock so far behind")
    parser.add_argument("--refresh-static", type=float, metavar="SECONDS", help="read static tables anew so often (default: once)")
    parser.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="for tables and topics")
    args = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("rtflow").getOrCreate()
    configure(spark)
    shared = _options(args.option)
    specs = json.loads(Path(args.tables).read_text(encoding="utf-8"))
    specs = [{**spec, "options": {**shared, **(spec.get("options") or {})}} for spec in specs]
    jobs = load_jobs(spark, args.jobs)
    tables = load_tables(spark, specs, args.watermark, streaming=args.mode != "batch", idle=args.idle)
    stored = {"storages": True, "options": shared}
    common = {"null_fill": args.null_fill, "join_salt": args.join_salt, "offset_hours": args.offset_hours}
    if args.mode == "batch":
        run_batch(spark, tables, jobs, args.directory, **common, **stored)
        return
    with StaticTables(spark, tables, specs, args.refresh_static):
        _run_streams(spark, tables, jobs, args, common, stored)


def _run_streams(spark: SparkSession, tables: dict, jobs: list, args: argparse.Namespace, common: dict, stored: dict) -> None:
    if args.mode in ("materialised", "shared"):
        written = "shared" if args.mode == "shared" else "all"
        queries = start_materialised(
            spark, tables, jobs, args.directory, args.available_now, delay=args.watermark, written=written,
            **common, **stored,
        )
    else:
        sinks = configured_sinks(jobs, stored["options"], args.offset_hours)
        queries = start(build(spark, tables, jobs, **common), sinks, f"{args.directory}/checkpoints", args.available_now)
    if args.available_now:
        for query in queries.values():
            query.awaitTermination()
    elif queries:
        spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()
