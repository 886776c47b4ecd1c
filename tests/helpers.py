"""Small tables for the tests, and plain-Python models of the window operators."""

from collections import defaultdict
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from rtflow.sources import stream_files, with_event_time

EPOCH = datetime(1970, 1, 1)


def micros(time):
    return round((time - EPOCH) / timedelta(microseconds=1))


def table(spark, rows, columns):
    """Rows whose first value is the event time in seconds (or None) since 1970, read as UTC."""
    schema = ", ".join(["__m bigint", *columns])
    data = [(None if row[0] is None else round(row[0] * 1_000_000), *row[1:]) for row in rows]
    df = spark.createDataFrame(data, schema)
    return with_event_time(df.withColumn("event_time", F.timestamp_micros("__m")).drop("__m"))


def as_stream(spark, df, directory):
    df.write.mode("append").parquet(str(directory))
    return stream_files(spark, str(directory), df.schema, "parquet")


def result(df, *columns):
    """Sorted rows of ``(event time in seconds, *columns)``."""
    rows = df.select(F.unix_micros("event_time").alias("t"), *columns).collect()
    return sorted(((row[0] / 1_000_000, *row[1:]) for row in rows), key=repr)


def utc_text(seconds):
    return (datetime.fromtimestamp(0, timezone.utc) + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")


def sliding(rows, size, step):
    """``{(window start, key): values}`` for rows of ``(time, key, value)``."""
    windows = defaultdict(list)
    for time, key, value in rows:
        if time is None:
            continue
        start = time // step * step
        while start > time - size:
            windows[start, key].append(value)
            start -= step
    return windows


def sessions(rows, gap):
    """``{(session start, session end, key): values}`` for rows of ``(time, key, value)``."""
    by_key = defaultdict(list)
    for time, key, value in rows:
        if time is not None:
            by_key[key].append((time, value))
    found = {}
    for key, events in by_key.items():
        events.sort(key=lambda event: event[0])
        current = []
        for event in events:
            if current and event[0] - current[-1][0] > gap:
                found[current[0][0], current[-1][0] + gap, key] = [value for _, value in current]
                current = []
            current.append(event)
        found[current[0][0], current[-1][0] + gap, key] = [value for _, value in current]
    return found
