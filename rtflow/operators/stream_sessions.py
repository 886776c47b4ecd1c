"""Sessions of a stream that collect sets, found in chunks of rows before Spark merges them.

Spark gives each row a session window of its own and merges them in order, within each map task first. A
``collect_set`` merges a row's set of one value into the session's set then, and that set (Scala's
``mutable.HashSet``) makes room for the size of what is added, not for its own: it stays at 16 places,
and each merge walks through a sixteenth of all values of the session. Time grows with the square of the
distinct values that a task has.

So rows get the session windows of a chunk of their task's rows, which a small Arrow function finds from the
times and keys. Rows of one chunk and session have equal windows, and Spark adds up equal windows row by
row, in a set that grows with its values; only the sets of chunks are merged. The windows that Spark merges
are unions of windows that it would have merged in the same map task, so the sessions, and what of them
is late, are those of single rows.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from rtflow.functions.aggregates import collects_set
from rtflow.operators.batch_windows import MICROS, span
from rtflow.operators.grouping import Grouping
from rtflow.schema import WINDOW

#: A chunk has at least so many rows, or bytes of times and keys, unless the task's rows end.
CHUNK_ROWS, CHUNK_BYTES = 1 << 18, 1 << 25

#: Types of keys that Arrow tells apart wherever Spark does.
_KEYS = (
    T.StringType, T.BinaryType, T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType,
    T.TimestampType, T.TimestampNTZType,
)

_LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def found_in_chunks(df: DataFrame, grouping: Grouping) -> bool:
    """Whether sessions are found in chunks first: where sets are collected, and no aggregate minds the order of rows.

    Without sessions merged within map tasks a late row would be dropped for itself, not with its session.
    """
    return (
        grouping.splits
        and any(collects_set(expression) for expression in (*(e for e, _ in grouping.aggregates), grouping.having or ""))
        and df.sparkSession.conf.get(_LOCAL_MERGE) == "true"
        and all(isinstance(field.dataType, _KEYS) for field in df.select(*grouping.key_columns()).schema)
    )


def with_sessions(df: DataFrame, time: str, gap: int, grouping: Grouping) -> DataFrame:
    """Add the window column: the session that a row has in its chunk. ``time`` is the column with the watermark."""
    spans = _finder(gap * MICROS)(F.unix_micros(time), *grouping.key_columns())
    bounds = {"__first": F.timestamp_micros("__span.first"), "__last": F.timestamp_micros("__span.last")}
    rows = df.withColumn("__span", spans).withColumns(bounds).withMetadata("__first", df.schema[time].metadata)
    return rows.withColumn(WINDOW, span(gap)).drop("__span", *bounds)


def _finder(gap: int):
    """From the times in microseconds and the keys of rows to the first and last time of each row's session."""
    # Only jobs that need them import these, and executors with the functions, which are sent whole.
    import numpy as np
    import pyarrow as pa

    rows, size = CHUNK_ROWS, CHUNK_BYTES

    def sessions(time: pa.Array, *keys: pa.Array) -> pa.Array:
        missing = time.is_null().to_numpy(zero_copy_only=False)
        micros = time.fill_null(0).to_numpy(zero_copy_only=False)
        group = missing.astype(np.int64)  # rows without a time are in no session
        for key in keys:
            codes = key.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
            group = np.unique(group * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
        order = np.lexsort((micros, group))
        group, sorted_micros = group[order], micros[order]
        begins = np.ones(len(order), dtype=bool)
        # Unsigned, the distance of any two times fits. Sessions that just touch are left for Spark to join.
        begins[1:] = (group[1:] != group[:-1]) | (np.diff(sorted_micros.view(np.uint64)) >= np.uint64(gap))
        starts, number = np.flatnonzero(begins), np.cumsum(begins) - 1
        first, last = np.empty_like(micros), np.empty_like(micros)
        first[order] = sorted_micros[starts][number]
        last[order] = sorted_micros[np.append(starts[1:], len(order)) - 1][number]
        return pa.StructArray.from_arrays([pa.array(first), pa.array(last)], ["first", "last"], mask=pa.array(missing))

    def found(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        held, n, n_bytes = [], 0, 0
        for batch in batches:
            held.append(batch)
            n, n_bytes = n + len(batch[0]), n_bytes + sum(column.nbytes for column in batch)
            if n >= rows or n_bytes >= size:
                yield sessions(*map(pa.concat_arrays, zip(*held)))
                held, n, n_bytes = [], 0, 0
        if n:
            yield sessions(*map(pa.concat_arrays, zip(*held)))

    # What it finds hangs on which rows come together, so Spark must not run it twice for one row.
    return F.arrow_udf(found, "first bigint, last bigint").asNondeterministic()
