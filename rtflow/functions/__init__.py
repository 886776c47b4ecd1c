from rtflow.functions.aggregates import split_aggregates
from rtflow.functions.time import TIME_PATTERN, register_functions, time2str, utc2local

__all__ = ["TIME_PATTERN", "register_functions", "split_aggregates", "time2str", "utc2local"]
