"""Job configurations over ``events`` (a stream), ``customer`` and ``orders`` (static tables)."""

from __future__ import annotations


def job(output: str, inputs: list[str], sql: str, **config) -> dict:
    window = {"window_type": "none", "window_size": None, "slide_size": None, "session_gap": None}
    return {
        "name": output,
        "input_table_list": inputs,
        "output_table": output,
        "process_config": {**window, **config, "sql": sql},
    }


def tumble(size: int) -> dict:
    return {"window_type": "tumble", "window_size": size}


def slide(size: int, step: int) -> dict:
    return {"window_type": "slide", "window_size": size, "slide_size": step}


def session(gap: int) -> dict:
    return {"window_type": "session", "session_gap": gap}


# Single-table jobs without a window -----------------------------------------------------------

PROJECT_FILTER = [
    job(
        "picked",
        ["events"],
        "select event_id, user_id, event_type as kind, value from events where value > 20 and event_type <> 'error'",
    )
]
NO_WINDOW = [job("passed", ["events"], "select event_id, user_id, `props` from events")]
SCALARS = [
    job(
        "scalars",
        ["events"],
        "select e.event_id, upper(e.event_type) as upper_type, substr(e.event_type, 2, 3) as part, "
        "concat(e.event_type, '-', cast(e.user_id as string)) as tag, length(e.props) as props_length, "
        "abs(e.value - 50) as distance, cast(floor(e.value) as int) as whole, "
        "case when e.value >= 100 then 'high' when e.value >= 10 then 'mid' else 'low' end as level, "
        "coalesce(nullif(e.event_type, 'error'), 'none') as outcome, hour(e.event_time) as hour_of_day "
        "from events e where e.value between 1 and 500 and e.event_type in ('click', 'view', 'error')",
    )
]
TIME_FUNCTIONS = [
    job(
        "times",
        ["events"],
        "select event_id, time2str(event_time) as as_text, utc2local(event_time) as as_local, "
        "time2str(utc2local(event_time)) as local_text from events",
    )
]
CAST = {
    **job("typed", ["events"], "select event_id, user_id, value, event_type from events"),
    "schema": [
        {"field_name": "event_time", "field_type": "TIMESTAMP"},
        {"field_name": "window_start", "field_type": "STRING"},
        {"field_name": "window_end", "field_type": "STRING"},
        {"field_name": "event_id", "field_type": "INT"},
        {"field_name": "user_id", "field_type": "STRING"},
        {"field_name": "value", "field_type": "DOUBLE"},
        {"field_name": "event_type", "field_type": "STRING"},
    ],
}

# Window aggregation ---------------------------------------------------------------------------

TUMBLE_SUM = [
    job(
        "sums",
        ["events"],
        "select event_type, sum(value) as total from events group by event_type",
        **tumble(3600),
    )
]
TUMBLE_COUNT = [job("counts", ["events"], "select count(*) as n from events", **tumble(3600))]
TUMBLE_OTHERS = [
    job(
        "others",
        ["events"],
        "select event_type, min(value) as low, avg(value) as mean, count(value) as n, "
        "count(distinct user_id) as users, max(value) - min(value) as spread from events group by event_type",
        **tumble(3600),
    )
]
TUMBLE_DISTINCT = [
    job(
        "distincts",
        ["events"],
        "select event_type, count(distinct user_id) as users, count(*) as n, sum(value) as total, avg(value) as mean "
        "from events group by event_type",
        **tumble(86400),
    )
]
TUMBLE_HAVING = [
    job(
        "havings",
        ["events"],
        "select event_type, sum(value) as total from events where value > 1 group by event_type "
        "having count(*) > 2 and total > 50",
        **tumble(3600),
    )
]
TUMBLE_EXPRESSION_KEY = [
    job(
        "levels",
        ["events"],
        "select upper(event_type) as kind, user_id, max(value) as top from events "
        "group by upper(event_type), user_id",
        **tumble(86400),
    )
]
SLIDE_MAX = [
    job(
        "tops",
        ["events"],
        "select event_type, max(value) as top from events group by event_type",
        **slide(3600, 1800),
    )
]
SLIDE_PANES = [
    job(
        "moving",
        ["events"],
        "select event_type, sum(value) as total, avg(value) as mean, count(*) as n, min(value) as low "
        "from events group by event_type",
        **slide(9000, 1800),
    )
]
#: Windows that overlap 86 times, and end inside a slide.
SLIDE_FINE = [
    job(
        "fine",
        ["events"],
        "select event_type, sum(value) as total, avg(value) as mean, count(*) as n, max(value) - min(value) as spread, "
        "stddev_samp(value) as deviation from events where value > 1 group by event_type having count(*) > 2",
        **slide(36000, 420),
    )
]
SLIDE_GAP_MAX = [
    job(
        "samples",
        ["events"],
        "select event_type, max(value) as top from events group by event_type",
        **slide(3600, 5400),
    )
]
SESSION_COUNT = [
    job(
        "sessions",
        ["events"],
        "select user_id, count(*) as n, sum(value) as total, min(value) as low, max(value) as top "
        "from events group by user_id",
        **session(600),
    )
]
SESSION_SMALL_KEYS = [
    job(
        "small_sessions",
        ["events"],
        "select user_id, count(*) as n, sum(value) as total, count(distinct event_type) as kinds "
        "from events group by user_id",
        **session(600),
    )
]
SESSION_OTHERS = [
    job(
        "session_kinds",
        ["events"],
        "select user_id, count(distinct event_type) as kinds, max(value) - min(value) as spread "
        "from events group by user_id having count(*) > 1",
        **session(1800),
    )
]
SESSION_GLOBAL = [job("bursts", ["events"], "select count(*) as n, avg(value) as mean from events", **session(300))]

SLIDE_HAVING = [
    job(
        "busy",
        ["events"],
        "select event_type, sum(value) / count(*) as mean, max(value) - min(value) as spread from events "
        "group by event_type having count(*) > 3 and event_type <> 'error'",
        **slide(9000, 1800),
    )
]
SLIDE_DECIMAL = [
    job("prices", ["events"], "select event_type, cast(value as decimal(10,2)) as price from events"),
    job(
        "price_sums",
        ["prices"],
        "select event_type, cast(sum(price) as string) as total, cast(max(price) as string) as top from prices "
        "group by event_type",
        **slide(9000, 1800),
    ),
]
#: Decimals that are products of whole numbers, so that engines agree on their digits.
_PRICE_4 = "cast(cast(event_id as decimal(14,0)) * cast('0.0137' as decimal(6,4)) as decimal(20,4))"
_PRICE_18 = "cast(cast(event_id as decimal(18,0)) * cast('1.000000000000001371' as decimal(19,18)) as decimal(38,18))"
_AVERAGES = f"cast(avg({_PRICE_4}) as string) as mean_4, cast(avg({_PRICE_18}) as string) as mean_18"
SLIDE_AVG_DECIMAL = [
    job("mean_prices", ["events"], f"select event_type, cast(avg({_PRICE_4}) as string) as mean_4 from events group by event_type", **slide(9000, 1800))
]
SLIDE_AVG_WIDE = [job("wide_prices", ["events"], f"select event_type, {_AVERAGES} from events group by event_type", **slide(9000, 1800))]
SESSION_AVG_DECIMAL = [
    job("session_prices", ["events"], f"select user_id, cast(avg({_PRICE_4}) as string) as mean_4 from events group by user_id", **session(1800))
]
SESSION_AVG_WIDE = [job("wide_sessions", ["events"], f"select user_id, {_AVERAGES} from events group by user_id", **session(1800))]
_MOMENTS = (
    "var_samp(ln(value + 1)) as variance, stddev_pop(value) as deviation, covar_pop(ln(value + 1), user_id / 700) as together, "
    "min_by(value, event_id) as first_value, max_by(value, event_id) as last_value, size(collect_set(user_id)) as users, "
    "bool_or(value > 100) as high, count_if(value > 50) as n_high"
)
SLIDE_MOMENTS = [job("moments", ["events"], f"select event_type, {_MOMENTS} from events group by event_type", **slide(9000, 1800))]
SESSION_MOMENTS = [job("session_moments", ["events"], f"select event_type, {_MOMENTS} from events group by event_type", **session(1800))]
SESSION_HAVING = [
    job(
        "long_sessions",
        ["events"],
        "select user_id, sum(value) / count(*) as mean from events group by user_id having count(*) > 1",
        **session(1800),
    )
]
SESSION_GLOBAL_DISTINCT = [
    job(
        "crowds",
        ["events"],
        "select count(distinct user_id) as users, max(value) - min(value) as spread from events having count(*) > 1",
        **session(300),
    )
]
DISTINCT_HAVING = [
    job(
        "many_users",
        ["events"],
        "select event_type, count(distinct user_id) as users from events group by event_type "
        "having count(distinct user_id) > 3",
        **tumble(21600),
    )
]

# Joins ----------------------------------------------------------------------------------------

SIDES = [
    job("purchases", ["events"], "select user_id, event_id, value from events where event_type = 'purchase'"),
    job("clicks", ["events"], "select user_id, event_id, props from events where event_type = 'click'"),
]


def stream_join(how: str, size: int = 21600, where: str = "") -> list[dict]:
    return [
        *SIDES,
        job(
            "joined",
            ["purchases", "clicks"],
            "select a.user_id, a.event_id as purchase_id, a.value, b.user_id as click_user, b.event_id as click_id "
            f"from purchases a {how} join clicks b on a.user_id = b.user_id {where}",
            **tumble(size),
        ),
    ]


#: Every second user is unknown.
KNOWN = "case when user_id % 2 = 0 then user_id end as user_id"


def null_keys(how: str) -> list[dict]:
    """A join of purchases, half of them without a key, with clicks."""
    known = f"select {KNOWN}, event_id, value from events where event_type = 'purchase'"
    return [job("purchases", ["events"], known), SIDES[1], stream_join(how)[-1]]


def static_null_keys(how: str) -> list[dict]:
    """Look customers up by a key that half of the events lack."""
    found = (
        "select e.event_id, e.user_id, e.value, c.c_name, c.c_nationkey "
        f"from known e {how} join customer c on e.user_id = c.c_custkey"
    )
    known = job("known", ["events"], f"select event_id, {KNOWN}, value from events")
    return [known, job("looked_up", ["known", "customer"], found)]


def static_join(how: str, where: str = "") -> list[dict]:
    """Look up customers; the left join does so by a key of which only some are customers."""
    key = "event_id" if how == "left" else "user_id"
    return [
        job(
            "looked_up",
            ["events", "customer"],
            "select e.event_id, e.user_id, e.value, c.c_name, c.c_nationkey, c.c_acctbal "
            f"from events e {how} join customer c on e.{key} = c.c_custkey {where}",
        )
    ]


STATIC_MANY = [
    job(
        "with_orders",
        ["events", "orders"],
        "select e.user_id, e.value, o.o_orderpriority, o.o_totalprice "
        "from events e join orders o on o.o_custkey = e.user_id",
    ),
    job(
        "order_value",
        ["with_orders"],
        "select o_orderpriority, count(*) as n, sum(o_totalprice) as total from with_orders group by o_orderpriority",
        **tumble(86400),
    ),
]

# Chains ---------------------------------------------------------------------------------------

CHAIN_TUMBLE_TUMBLE = [
    *TUMBLE_SUM,
    job("kinds", ["sums"], "select count(*) as kinds, max(total) as top from sums", **tumble(7200)),
]
CHAIN_TUMBLE_SLIDE_TUMBLE = [
    *TUMBLE_SUM,
    job(
        "sampled",
        ["sums"],
        "select event_type, sum(total) as total, count(*) as hours from sums group by event_type",
        **slide(7200, 10800),
    ),
    job("daily", ["sampled"], "select sum(hours) as hours, sum(total) as total from sampled", **tumble(86400)),
]
CHAIN_JOIN_TUMBLE = [
    *stream_join("inner"),
    job(
        "join_tops",
        ["joined"],
        "select user_id, max(value) as top, count(*) as n from joined group by user_id",
        **tumble(43200),
    ),
]
CHAIN_SESSION_TUMBLE = [
    *SESSION_COUNT,
    job("session_hours", ["sessions"], "select count(*) as sessions, sum(n) as events from sessions", **tumble(3600)),
]

# Whole flows ----------------------------------------------------------------------------------

DATAFLOW_1 = [
    job("strong", ["events"], "select user_id, `event_type`, value from events where value > 30"),
    job(
        "strong_samples",
        ["strong"],
        "select `event_type`, max(value) as max_value from strong group by `event_type`",
        **slide(3600, 5400),
    ),
    job(
        "strong_sums",
        ["strong"],
        "select `event_type`, sum(value) as sum_value from strong group by `event_type`",
        **tumble(3600),
    ),
]
DATAFLOW_2 = [
    *stream_join("inner"),
    *static_join("left"),
    job(
        "joined_tops",
        ["joined"],
        "select user_id, max(value) as max_value from joined group by user_id",
        **tumble(21600),
    ),
]
DATAFLOW_3 = [
    job(
        "kind_tops",
        ["events"],
        "select `event_type`, max(value) as max_value from events group by `event_type`",
        **tumble(3600),
    ),
    job("kind_counts", ["kind_tops"], "select count(*) as my_count from kind_tops", **tumble(3600)),
]
