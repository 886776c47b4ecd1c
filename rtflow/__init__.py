"""Config-driven real-time data flows on Spark DataFrames, in batch or as streams."""

from rtflow.operators import JoinSpec, WindowSpec, join_static, join_windowed, project, window_aggregate
from rtflow.plans import Job, build, load_jobs
from rtflow.sources import TableSpec, load_tables
from rtflow.table import FlowTable

__all__ = [
    "FlowTable",
    "Job",
    "JoinSpec",
    "TableSpec",
    "WindowSpec",
    "build",
    "join_static",
    "join_windowed",
    "load_jobs",
    "load_tables",
    "project",
    "window_aggregate",
]
