from rtflow.sources.codec import decode_json
from rtflow.sources.tables import (
    WATERMARK_DELAY,
    TableSpec,
    load,
    load_tables,
    read_files,
    read_jdbc,
    stream_files,
    stream_topic,
    with_event_time,
)

__all__ = [
    "WATERMARK_DELAY",
    "TableSpec",
    "decode_json",
    "load",
    "load_tables",
    "read_files",
    "read_jdbc",
    "stream_files",
    "stream_topic",
    "with_event_time",
]
