from rtflow.streaming.runner import (
    build_once,
    configure,
    configured_sinks,
    run_available,
    run_batch,
    scratch_dir,
    start,
    start_materialised,
)
from rtflow.streaming.sinks import Folder, encode_json, fan_out, file_writer, storage_writer, topic_writer, write_topic
from rtflow.streaming.statics import StaticTables

__all__ = [
    "Folder",
    "StaticTables",
    "build_once",
    "configure",
    "configured_sinks",
    "encode_json",
    "fan_out",
    "file_writer",
    "run_available",
    "run_batch",
    "scratch_dir",
    "start",
    "start_materialised",
    "storage_writer",
    "topic_writer",
    "write_topic",
]
