"""The queries of ``queries.py`` in plain SQL, as DuckDB runs it on the same tables."""

from __future__ import annotations

from rtflow.examples.queries import LATE_TYPE, SPLIT

EVENTS = "(SELECT ts AS event_time, event_id, user_id, event_type, value, props FROM events)"


def _text(time: str) -> str:
    return f"strftime({time}, '%Y-%m-%d %H:%M:%S')"


def _bucket(time: str, size: int) -> str:
    return f"time_bucket(INTERVAL {size} SECOND, {time}, TIMESTAMP '1970-01-01 00:00:00')"


def _times(start: str, end: str, event_time: str | None = None) -> str:
    return f"{event_time or end} AS event_time, {_text(start)} AS window_start, {_text(end)} AS window_end"


def _watermark(source: str = "events", time: str = "ts") -> str:
    """How far the watermark gets: whole milliseconds of the latest time, less two seconds."""
    return f"(SELECT date_trunc('milliseconds', max({time})) - INTERVAL 2 SECOND FROM {source})"


def _closed(sql: str, watermark: str | None = None) -> str:
    return f"SELECT * FROM ({sql}) AS all_windows WHERE event_time <= {watermark or _watermark()}"


def _no_window(columns: str, source: str = EVENTS, where: str = "TRUE") -> str:
    return f"SELECT {_times('event_time', 'event_time', 'event_time')}, {columns} FROM {source} AS e WHERE {where}"


def _tumble(
    columns: str, size: int, keys: str = "", source: str = EVENTS, where: str = "TRUE", having: str = "TRUE"
) -> str:
    start = f"{_bucket('event_time', size)}"
    end = f"({start} + INTERVAL {size} SECOND)"
    grouping = f"{start}{', ' + keys if keys else ''}"
    return (
        f"SELECT {_times(start, end)}, {columns} FROM {source} AS e WHERE {where} "
        f"GROUP BY {grouping} HAVING {having}"
    )


def _slide(
    columns: str, size: int, step: int, keys: str = "", source: str = EVENTS, counted: str = "TRUE"
) -> str:
    """Copy each row into the windows that hold it; with step > size that is one window or none."""
    copies = -(-size // step)
    latest = _bucket("event_time", step)
    rows = (
        f"(SELECT e.*, {latest} - i.n * INTERVAL {step} SECOND AS w FROM {source} AS e, "
        f"(SELECT unnest(range({copies})) AS n) AS i)"
    )
    end = f"(w + INTERVAL {size} SECOND)"
    return (
        f"SELECT {_times('w', end)}, {columns} FROM {rows} AS e WHERE event_time < {end} AND ({counted}) "
        f"GROUP BY w{', ' + keys if keys else ''}"
    )


def _session(columns: str, gap: int, key: str = "", having: str = "TRUE") -> str:
    partition = f"PARTITION BY {key} " if key else ""
    fresh = (
        f"CASE WHEN event_time - lag(event_time) OVER ({partition}ORDER BY event_time) <= INTERVAL {gap} SECOND "
        "THEN 0 ELSE 1 END"
    )
    numbered = (
        f"(SELECT *, sum(fresh) OVER ({partition}ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS session_number "
        f"FROM (SELECT *, {fresh} AS fresh FROM {EVENTS} AS e) AS marked)"
    )
    end = f"(max(event_time) + INTERVAL {gap} SECOND)"
    return (
        f"SELECT {_times('min(event_time)', end)}, {columns} FROM {numbered} AS e "
        f"GROUP BY {key + ', ' if key else ''}session_number HAVING {having}"
    )


#: Fixed value: the key of joins that half of the rows lack.
_KNOWN = "CASE WHEN user_id % 2 = 0 THEN user_id END"


def _side(kind: str, size: int, key: str = "user_id") -> str:
    return (
        f"(SELECT {key} AS user_id, event_id, value, props, {_bucket('ts', size)} AS w FROM events WHERE event_type = '{kind}')"
    )


def _stream_join(
    how: str, size: int = 21600, where: str = "TRUE", click_user: str = "b.user_id", key: str = "user_id"
) -> str:
    left = how != "right"
    side = "a" if left else "b"
    return (
        f"SELECT {_times(f'{side}.w', f'({side}.w + INTERVAL {size} SECOND)')}, "
        f"a.user_id, a.event_id AS purchase_id, a.value, {click_user} AS click_user, b.event_id AS click_id "
        f"FROM {_side('purchase', size, key)} AS a {how} JOIN {_side('click', size)} AS b "
        f"ON a.w = b.w AND a.user_id = b.user_id WHERE {where}"
    )


_JOIN_WATERMARK = (
    "(SELECT date_trunc('milliseconds', least("
    "max(ts) FILTER (WHERE event_type = 'purchase'), max(ts) FILTER (WHERE event_type = 'click'))) "
    "- INTERVAL 2 SECOND FROM events)"
)


def _closed_join(how: str, key: str = "user_id") -> str:
    """Matches are written at once, misses when their window closes."""
    missing = "click_id" if how == "left" else "purchase_id"
    return (
        f"SELECT * FROM ({_stream_join(how, key=key)}) AS j "
        f"WHERE {missing} IS NOT NULL OR event_time <= {_JOIN_WATERMARK}"
    )


def _static_join(how: str, fill: bool = False) -> str:
    key = "event_id" if how == "LEFT" else "user_id"
    columns = "c.c_name, c.c_nationkey, round(c.c_acctbal, 6) AS c_acctbal"
    if fill:
        missed = "CASE WHEN c.c_custkey IS NULL THEN {} ELSE {} END AS {}"
        columns = ", ".join(
            (
                missed.format("'NULL'", "c.c_name", "c_name"),
                missed.format("0", "c.c_nationkey", "c_nationkey"),
                missed.format("0.0::DOUBLE", "round(c.c_acctbal, 6)", "c_acctbal"),
            )
        )
    return (
        f"SELECT {_times('e.event_time', 'e.event_time', 'e.event_time')}, e.event_id, e.user_id, "
        f"round(e.value, 6) AS value, {columns} FROM {EVENTS} AS e {how} JOIN customer AS c "
        f"ON e.{key} = c.c_custkey"
    )


def _static_null_keys() -> str:
    events = f"(SELECT event_time, event_id, {_KNOWN} AS user_id, value FROM {EVENTS} AS x)"
    return (
        f"SELECT {_times('e.event_time', 'e.event_time', 'e.event_time')}, e.event_id, e.user_id, "
        f"round(e.value, 6) AS value, c.c_name, c.c_nationkey FROM {events} AS e LEFT JOIN customer AS c "
        "ON e.user_id = c.c_custkey"
    )


def _sum(column: str, name: str) -> str:
    return f"CAST(sum({column}) AS BIGINT) AS {name}"


def _exact_average(units: str, scale: int, name: str) -> str:
    """The average of ``event_id`` times so many units, as text; the units are 10,000 of the last digit."""
    total = f"sum(CAST(event_id AS HUGEINT) * {units})"
    last = f"(({total} * 20000 + count(*)) // (2 * count(*)))"
    one = f"CAST('1{'0' * scale}' AS HUGEINT)"
    return f"({last} // {one})::VARCHAR || '.' || lpad(({last} % {one})::VARCHAR, {scale}, '0') AS {name}"


def _union(parts: dict[str, tuple[str, dict[str, str]]]) -> str:
    """Outputs of several jobs; ``columns`` of each name what it has, in one common order."""
    every: dict[str, str] = {}
    for _, columns in parts.values():
        every.update(columns)
    selects = []
    for name, (sql, columns) in parts.items():
        fields = [
            f"{column}" if column in columns else f"CAST(NULL AS {kind}) AS {column}"
            for column, kind in every.items()
        ]
        times = "event_time, window_start, window_end"
        selects.append(f"SELECT {times}, {', '.join(fields)}, '{name}' AS job FROM ({sql}) AS t")
    return " UNION ALL ".join(selects)


def oracle_sql() -> dict[str, str]:
    hourly = "event_type, round(sum(value), 6) AS total"
    tumble_sum = _tumble(hourly, 3600, "event_type")
    exact_sums = _tumble("event_type, sum(value) AS total", 3600, "event_type")
    tumble_count = _tumble("count(*) AS n", 3600)
    distinct = _tumble(
        "event_type, count(DISTINCT user_id) AS users, count(*) AS n, round(sum(value), 6) AS total, "
        "round(avg(value), 6) AS mean",
        86400,
        "event_type",
    )
    having = _tumble(hourly, 3600, "event_type", where="value > 1", having="count(*) > 2 AND sum(value) > 50")
    top = "event_type, max(value) AS top"
    slide_max = _slide(top, 3600, 1800, "event_type")
    moving = (
        "event_type, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, count(*) AS n, min(value) AS low"
    )
    panes = _slide(moving, 9000, 1800, "event_type")
    fine = _slide(
        "event_type, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, count(*) AS n, "
        "round(max(value) - min(value), 6) AS spread, round(stddev_samp(value), 6) AS deviation",
        36000, 420, "event_type", f"(SELECT * FROM {EVENTS} AS v WHERE value > 1)",
    ) + " HAVING count(*) > 2"
    gapped = _slide(top, 3600, 5400, "event_type")
    spread = "round(max(value) - min(value), 6) AS spread"
    mean = "round(sum(value) / count(*), 6) AS mean"
    busy = _slide(f"event_type, {mean}, {spread}", 9000, 1800, "event_type")
    busy += " HAVING count(*) > 3 AND event_type <> 'error'"
    prices = "(SELECT event_time, event_type, CAST(value AS DECIMAL(10,2)) AS price FROM " + EVENTS + " AS p)"
    whole_prices = f"(SELECT date_trunc('second', event_time) AS event_time, event_type, price FROM {prices} AS w)"
    price_sums = _slide(
        "event_type, CAST(sum(price) AS VARCHAR) AS total, CAST(max(price) AS VARCHAR) AS top", 9000, 1800, "event_type", whole_prices
    )
    mean_4, mean_18 = _exact_average("137", 8, "mean_4"), _exact_average("1000000000000001371", 22, "mean_18")
    slide_prices = [_slide(f"event_type, {c}", 9000, 1800, "event_type") for c in (mean_4, f"{mean_4}, {mean_18}")]
    session_prices = [_session(f"user_id, {c}", 1800, "user_id") for c in (mean_4, f"{mean_4}, {mean_18}")]
    moments = (
        "event_type, round(var_samp(ln(value + 1)), 6) AS variance, round(stddev_pop(value), 6) AS deviation, "
        "round(covar_pop(ln(value + 1), user_id / 700.0), 6) AS together, round(arg_min(value, event_id), 6) AS first_value, "
        "round(arg_max(value, event_id), 6) AS last_value, CAST(count(DISTINCT user_id) AS INTEGER) AS users, "
        "bool_or(value > 100) AS high, count(*) FILTER (value > 50) AS n_high"
    )
    slide_moments, session_moments = _slide(moments, 9000, 1800, "event_type"), _session(moments, 1800, "event_type")
    many_users = _tumble(
        "event_type, count(DISTINCT user_id) AS users", 21600, "event_type", having="count(DISTINCT user_id) > 3"
    )
    per_user = "user_id, count(*) AS n, round(sum(value), 6) AS total, min(value) AS low, max(value) AS top"
    sessions = _session(per_user, 600, "user_id")
    bursts = _session("count(*) AS n, round(avg(value), 6) AS mean", 300)
    two_hours = _tumble("count(*) AS kinds, round(max(total), 6) AS top", 7200, source=f"({exact_sums})")
    sampled = _slide(
        "event_type, sum(total) AS total, count(*) AS hours", 7200, 10800, "event_type", f"({exact_sums})"
    )
    daily = _tumble(
        f"{_sum('hours', 'hours')}, round(sum(total), 6) AS total", 86400, source=f"({sampled})"
    )
    join_tops = _tumble(
        "user_id, max(value) AS top, count(*) AS n", 43200, "user_id", f"({_stream_join('inner')})"
    )
    session_hours = _tumble(
        f"count(*) AS sessions, {_sum('n', 'events')}", 3600, source=f"({sessions})"
    )
    strong = _no_window("user_id, event_type, round(value, 6) AS value", where="value > 30")
    strong_rows = "(SELECT ts AS event_time, event_type, value FROM events WHERE value > 30)"
    flow_1 = _union(
        {
            "strong": (strong, {"user_id": "BIGINT", "event_type": "VARCHAR", "value": "DOUBLE"}),
            "strong_samples": (
                _slide("event_type, max(value) AS max_value", 3600, 5400, "event_type", strong_rows),
                {"event_type": "VARCHAR", "max_value": "DOUBLE"},
            ),
            "strong_sums": (
                _tumble("event_type, round(sum(value), 6) AS sum_value", 3600, "event_type", strong_rows),
                {"event_type": "VARCHAR", "sum_value": "DOUBLE"},
            ),
        }
    )
    strong_mark = _watermark("events WHERE value > 30")
    flow_1_closed = _union(
        {
            "strong": (strong, {"user_id": "BIGINT", "event_type": "VARCHAR", "value": "DOUBLE"}),
            "strong_samples": (
                _closed(_slide("event_type, max(value) AS max_value", 3600, 5400, "event_type", strong_rows), strong_mark),
                {"event_type": "VARCHAR", "max_value": "DOUBLE"},
            ),
            "strong_sums": (
                _closed(_tumble("event_type, round(sum(value), 6) AS sum_value", 3600, "event_type", strong_rows), strong_mark),
                {"event_type": "VARCHAR", "sum_value": "DOUBLE"},
            ),
        }
    )
    kind_tops = _tumble("event_type, max(value) AS max_value", 3600, "event_type")
    kind_counts = _tumble("count(*) AS my_count", 3600, source=f"({kind_tops})")
    tops_columns = {"event_type": "VARCHAR", "max_value": "DOUBLE"}
    flow_2 = _union(
        {
            "joined": (
                _stream_join("inner"),
                {
                    "user_id": "BIGINT",
                    "purchase_id": "BIGINT",
                    "value": "DOUBLE",
                    "click_user": "BIGINT",
                    "click_id": "BIGINT",
                },
            ),
            "looked_up": (
                _static_join("LEFT", fill=True),
                {
                    "event_id": "BIGINT",
                    "user_id": "BIGINT",
                    "value": "DOUBLE",
                    "c_name": "VARCHAR",
                    "c_nationkey": "INTEGER",
                    "c_acctbal": "DOUBLE",
                },
            ),
            "joined_tops": (
                _tumble(
                    "user_id, max(value) AS max_value", 21600, "user_id", f"({_stream_join('inner')})"
                ),
                {"user_id": "BIGINT", "max_value": "DOUBLE"},
            ),
        }
    )
    many = (
        "(SELECT e.ts AS event_time, o.o_orderpriority, o.o_totalprice FROM events AS e "
        "JOIN orders AS o ON o.o_custkey = e.user_id)"
    )
    split = f"TIMESTAMP '{SPLIT}'"
    passed = _watermark(f"(SELECT ts FROM events WHERE ts < {split} AND event_type <> '{LATE_TYPE}')")
    in_time = (
        f"ts >= {split} OR event_type <> '{LATE_TYPE}' "
        f"OR {_bucket('ts', 3600)} + INTERVAL 3600 SECOND > {passed}"
    )
    late_drop = _closed(
        _tumble(hourly, 3600, "event_type", f"(SELECT ts AS event_time, * FROM events WHERE {in_time})")
    )
    on_time = f"event_time >= {split} OR event_type <> '{LATE_TYPE}' OR w + INTERVAL {{}} SECOND > {passed}"
    late_slide = _closed(_slide(top, 3600, 1800, "event_type", counted=on_time.format(3600)))
    late_slide_many = _closed(_slide(moving, 9000, 1800, "event_type", counted=on_time.format(9000)))
    whole_seconds = "(SELECT date_trunc('second', ts) AS event_time, * FROM events)"

    batch = {
        "project_filter": _no_window(
            "event_id, user_id, event_type AS kind, round(value, 6) AS value",
            where="value > 20 AND event_type <> 'error'",
        ),
        "nowindow_time_cols": _no_window("event_id, user_id, props"),
        "scalar_passthrough": _no_window(
            "event_id, upper(event_type) AS upper_type, substr(event_type, 2, 3) AS part, "
            "event_type || '-' || CAST(user_id AS VARCHAR) AS tag, CAST(length(props) AS INTEGER) AS props_length, "
            "round(abs(value - 50), 6) AS distance, CAST(floor(value) AS INTEGER) AS whole, "
            "CASE WHEN value >= 100 THEN 'high' WHEN value >= 10 THEN 'mid' ELSE 'low' END AS level, "
            "coalesce(nullif(event_type, 'error'), 'none') AS outcome, "
            "CAST(hour(event_time) AS INTEGER) AS hour_of_day",
            where="value BETWEEN 1 AND 500 AND event_type IN ('click', 'view', 'error')",
        ),
        "fn_time2str": _no_window(
            f"event_id, {_text('event_time')} AS as_text, event_time + INTERVAL 8 HOUR AS as_local, "
            f"{_text('event_time + INTERVAL 8 HOUR')} AS local_text"
        ),
        "fn_utc2local": (
            f"SELECT event_time, {_text('event_time + INTERVAL 8 HOUR')} AS window_start, "
            f"{_text('event_time + INTERVAL 8 HOUR')} AS window_end, event_id, "
            f"{_text('event_time + INTERVAL 8 HOUR')} AS as_text, event_time + INTERVAL 8 HOUR AS as_local, "
            f"{_text('event_time + INTERVAL 16 HOUR')} AS local_text FROM {EVENTS} AS e"
        ),
        "cast_output": _no_window(
            "CAST(event_id AS INTEGER) AS event_id, CAST(user_id AS VARCHAR) AS user_id, "
            "round(value, 6) AS value, event_type"
        ),
        "static_scan": (
            "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer"
        ),
        "json_decode": (
            "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(0 AS BIGINT) AS absent_number, "
            "CAST(NULL AS VARCHAR) AS absent_text, event_id FROM events"
        ),
        "json_encode": (
            f"SELECT '{{\"event_time\":\"' || {_text('ts')} || '\",\"event_id\":' || event_id || "
            "',\"user_id\":' || user_id || "
            "CASE WHEN event_type = 'error' THEN '' ELSE ',\"event_type\":\"' || event_type || '\"' END || "
            "',\"value\":' || value || "
            "',\"props\":\"' || replace(props, '\"', '\\\"') || '\"}' AS value FROM events"
        ),
        "tumble_sum": tumble_sum,
        "tumble_in_parts": _tumble(
            f"{hourly}, max(value) AS top", 3600, "event_type", where="value > 5", having="sum(value) > 20"
        ),
        "tumble_count_all": tumble_count,
        "tumble_other_aggs": _tumble(
            "event_type, min(value) AS low, round(avg(value), 6) AS mean, count(value) AS n, "
            "count(DISTINCT user_id) AS users, round(max(value) - min(value), 6) AS spread",
            3600,
            "event_type",
        ),
        "tumble_distinct": distinct,
        "tumble_having": having,
        "tumble_expression_key": _tumble(
            "upper(event_type) AS kind, user_id, max(value) AS top", 86400, "upper(event_type), user_id"
        ),
        "slide_max": slide_max,
        "slide_panes": panes,
        "slide_fine": fine,
        "slide_gap_max": gapped,
        "session_count": sessions,
        "session_small_keys": _session(
            "user_id, count(*) AS n, round(sum(value), 6) AS total, count(DISTINCT event_type) AS kinds",
            600,
            "user_id",
        ),
        "session_other_aggs": _session(
            "user_id, count(DISTINCT event_type) AS kinds, round(max(value) - min(value), 6) AS spread",
            1800,
            "user_id",
            "count(*) > 1",
        ),
        "session_global": bursts,
        "slide_having": busy,
        "slide_decimal": price_sums,
        "slide_avg_decimal": slide_prices[0],
        "slide_avg_wide": slide_prices[1],
        "session_avg_decimal": session_prices[0],
        "session_avg_wide": session_prices[1],
        "slide_moments": slide_moments,
        "session_moments": session_moments,
        "session_having": _session(f"user_id, {mean}", 1800, "user_id", "count(*) > 1"),
        "session_global_distinct": _session(f"count(DISTINCT user_id) AS users, {spread}", 300, having="count(*) > 1"),
        "ss_join_inner": _stream_join("inner"),
        "ss_join_left": _stream_join("left"),
        "ss_join_right": _stream_join("right"),
        "ss_join_salted": _stream_join("left"),
        "ss_join_where": _stream_join("left", where="a.value > 20 AND b.event_id IS NULL"),
        "ss_join_null_keys": _stream_join("left", key=_KNOWN),
        "ss_join_null_keys_right": _stream_join("right", key=_KNOWN),
        "static_join_null_keys": _static_null_keys(),
        "static_join_inner": _static_join("INNER"),
        "static_join_left": _static_join("LEFT"),
        "static_join_many": _tumble(
            "o_orderpriority, count(*) AS n, round(sum(o_totalprice), 6) AS total", 86400, "o_orderpriority", many
        ),
        "join_null_fill": _static_join("LEFT", fill=True),
        "ss_join_null_fill": (
            "SELECT event_time, window_start, window_end, "
            "coalesce(user_id, 0) AS user_id, coalesce(purchase_id, 0) AS purchase_id, "
            f"coalesce(value, 0.0) AS value, click_user, click_id FROM ({_stream_join('right')}) AS j"
        ),
        "chain_tumble_tumble": two_hours,
        "chain_tumble_slide_tumble": daily,
        "chain_join_tumble": join_tops,
        "chain_session_tumble": session_hours,
        "dataflow_01": flow_1,
        "dataflow_02": flow_2,
        "dataflow_03": _union(
            {"kind_tops": (kind_tops, tops_columns), "kind_counts": (kind_counts, {"my_count": "BIGINT"})}
        ),
        "dataflow_01_written": flow_1,
    }
    streams = {
        "src_events_stream": (
            "SELECT date_trunc('second', ts) AS event_time, event_id, user_id, event_type, "
            "round(value, 6) AS value, props FROM events"
        ),
        "sink_json": (
            f"SELECT '{{\"event_time\":\"' || {_text('event_time')} || '\",\"window_start\":\"' || "
            f"{_text('event_time')} || '\",\"window_end\":\"' || {_text('event_time')} || '\",\"event_id\":' || "
            "event_id || ',\"user_id\":' || user_id || ',\"kind\":\"' || event_type || '\",\"value\":' || value || '}' AS value "
            f"FROM {whole_seconds} AS e WHERE value > 20 AND event_type <> 'error'"
        ),
        "late_drop": late_drop,
        "late_slide": late_slide,
        "late_slide_many": late_slide_many,
        "stream_tumble_sum": _closed(tumble_sum),
        "stream_tumble_count_all": _closed(tumble_count),
        "stream_tumble_distinct": _closed(distinct),
        "stream_tumble_having": _closed(having, _watermark("events WHERE value > 1")),
        "stream_distinct_having": _closed(many_users),
        "stream_slide_having": _closed(busy),
        "stream_slide_max": _closed(slide_max),
        "stream_slide_panes": _closed(panes),
        "stream_slide_avg_wide": _closed(slide_prices[1]),
        "stream_session_avg_wide": _closed(session_prices[1]),
        "stream_slide_moments": _closed(slide_moments),
        "stream_session_moments": _closed(session_moments),
        "stream_slide_gap_max": _closed(gapped),
        "stream_session_count": _closed(sessions),
        "stream_session_global": _closed(bursts),
        "stream_join_inner": _stream_join("inner"),
        "stream_join_left": _closed_join("left"),
        "stream_join_right": _closed_join("right"),
        "stream_join_salted": _closed_join("right"),
        "stream_join_null_keys": _closed_join("left", _KNOWN),
        "stream_static_join_null_keys": _static_null_keys(),
        "stream_static_join_inner": _static_join("INNER"),
        "stream_static_join_kept": _static_join("INNER"),
        "stream_static_join_left": _static_join("LEFT", fill=True),
        "stream_chain_tumble_tumble": _closed(two_hours),
        "stream_chain_tumble_slide_tumble": _closed(daily),
        "stream_chain_join_tumble": _closed(join_tops, _JOIN_WATERMARK),
        "stream_chain_session_tumble": _closed(session_hours),
        "stream_dataflow_01_shared": flow_1_closed,
        "stream_dataflow_03_materialised": _union(
            {
                "kind_tops": (_closed(kind_tops), tops_columns),
                "kind_counts": (
                    _closed(kind_counts, _watermark(f"({_closed(kind_tops)})", "event_time")),
                    {"my_count": "BIGINT"},
                ),
            }
        ),
    }
    return {**batch, **streams}
