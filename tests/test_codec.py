import datetime
import json

import pytest
from pyspark.sql import functions as F, types as T

from rtflow.functions import register_functions, time2str, utc2local
from rtflow.functions.aggregates import split_aggregates
from rtflow.schema import cast_output, check_stream_schema, to_fields, to_struct
from rtflow.sources import decode_json
from rtflow.streaming import encode_json

FIELDS = [
    {"field_name": "event_time", "field_type": "TIMESTAMP"},
    {"field_name": "i", "field_type": "INT"},
    {"field_name": "l", "field_type": "LONG"},
    {"field_name": "b", "field_type": "BIGINT"},
    {"field_name": "f", "field_type": "FLOAT"},
    {"field_name": "d", "field_type": "DOUBLE"},
    {"field_name": "s", "field_type": "STRING"},
    {"field_name": "at", "field_type": "TIMESTAMP"},
]


def test_schema_forms():
    struct = to_struct(FIELDS)
    assert struct == to_struct(json.dumps(FIELDS)) == to_struct(struct)
    assert [f.dataType.simpleString() for f in struct] == [
        "timestamp", "int", "bigint", "bigint", "float", "double", "string", "timestamp",
    ]
    assert to_struct(to_fields(struct)) == struct
    with pytest.raises(ValueError, match="unknown type"):
        to_struct([{"field_name": "x", "field_type": "DECIMAL"}])
    with pytest.raises(ValueError, match="twice"):
        to_struct(FIELDS + FIELDS[:1])
    with pytest.raises(ValueError, match="no table type"):
        to_fields(T.StructType().add("x", T.BooleanType()))
    with pytest.raises(ValueError, match="first column"):
        check_stream_schema(to_struct(FIELDS[1:]))


def decoded(spark, *records):
    texts = [record if isinstance(record, str) else json.dumps(record) for record in records]
    df = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "id int, value string")
    rows = decode_json(df, FIELDS, keep=("id",)).orderBy("id")
    assert rows.schema.fields[:-1] == to_struct(FIELDS).fields
    return [tuple(row)[:-1] for row in rows.collect()]


def test_decode(spark):
    midnight = datetime.datetime(2021, 1, 1)
    good = (midnight, 7, 2**53 + 1, -3, 1.5, 2.25, "x", midnight)
    text, millis = "2021-01-01 00:00:00", 1609459200000
    assert decoded(
        spark,
        {"event_time": text, "i": 7, "l": 2**53 + 1, "b": -3, "f": 1.5, "d": 2.25, "s": "x", "at": text, "other": [1]},
        {"s": "x", "at": millis, "d": "2.25", "f": "1.5", "b": "-3", "l": str(2**53 + 1), "i": "7", "event_time": millis},
        {"event_time": str(millis), "i": " 7 ", "l": 2**53 + 1, "b": -3.9, "f": 1.5, "d": 2.25, "s": "x", "at": text + ".000"},
    ) == [good] * 3


def test_decode_missing_and_unreadable(spark):
    zeros = (None, 0, 0, 0, 0.0, 0.0, None, None)
    assert decoded(spark, {}, {"i": None, "s": None}, {"i": "", "l": "null", "event_time": ""}) == [zeros] * 3
    rows = decoded(spark, {"i": "seven", "l": True, "b": 2**70, "d": "1e3", "s": 12, "at": "soon", "event_time": "nothing"})
    assert rows == [(None, None, 1, None, 0.0, 1000.0, "12", None)]
    assert decoded(spark, {"s": {"nested": 1}, "i": 3000000000}) == [(None, None, 0, 0, 0.0, 0.0, '{"nested":1}', None)]


def test_decode_broken_records_to_nulls(spark):
    nothing = (None,) * len(FIELDS)
    assert decoded(spark, "not json", '{"i": 1', "", "[1]") == [nothing] * 4


def test_encode_and_back(spark):
    text = "2021-01-01 00:00:07"
    full = {"event_time": text, "i": 1, "l": 2, "b": 3, "f": 1.5, "d": 2.5, "s": 'q"', "at": 1609459200123}
    sparse = {"event_time": text, "i": 0, "l": 0, "b": 0, "f": 0.0, "d": 0.0}
    df = spark.createDataFrame([(json.dumps(full),), (json.dumps(sparse),)], "value string")
    rows = decode_json(df, FIELDS)
    encoded = [json.loads(row.value) for row in encode_json(rows).collect()]
    assert encoded == [full, sparse]
    assert decode_json(encode_json(rows), FIELDS).collect() == rows.collect()
    later = json.loads(encode_json(rows, offset_hours=8).first().value)
    assert later == {**full, "event_time": "2021-01-01 08:00:07"}


def test_cast_output(spark):
    df = spark.sql("select timestamp '2021-01-01' as event_time, '12' as i, 3 as s, cast(null as string) as d, 1.5D as f")
    schema = [FIELDS[0], FIELDS[6], FIELDS[1], FIELDS[5], FIELDS[4]]
    assert cast_output(df, schema).collect()[0][1:] == ("3", 12, None, 1.5)
    assert [(f.name, f.dataType) for f in cast_output(df, schema).schema] == [(f.name, f.dataType) for f in to_struct(schema)]
    with pytest.raises(ValueError, match="not in the output"):
        cast_output(df.drop("d"), schema)


def test_time_functions(spark):
    register_functions(spark, offset_hours=8)
    df = spark.sql("select timestamp '2021-01-01 20:00:07.9' as t")
    row = df.select(
        time2str("t"), time2str(F.col("t"), 8), F.expr("time2str(t)"), utc2local("t"), F.expr("utc2local(t)")
    ).first()
    moved = datetime.datetime(2021, 1, 2, 4, 0, 7, 900000)
    assert tuple(row) == ("2021-01-01 20:00:07", "2021-01-02 04:00:07", "2021-01-02 04:00:07", moved, moved)
    register_functions(spark)
    assert spark.sql("select time2str(timestamp '2021-01-01 20:00:07')").first()[0] == "2021-01-01 20:00:07"


@pytest.fixture(scope="module")
def abc(spark):
    return spark.createDataFrame([], "a int, b boolean, c string, e int")


@pytest.mark.parametrize(
    "expression",
    ["sum(distinct a)", "stddev(distinct a)", "median(a)", "count(a, b)", "max(a) filter (where b)", "upper(c)", "max(a) + a", "max(a) + median(a)", "sum(a) over ()"],
)
def test_what_cannot_be_split(abc, expression):
    assert split_aggregates(abc, [("count(*)", "n"), (expression, "x")]) is None
    assert split_aggregates(abc, [("count(*)", "n")], f"({expression}) is not null") is None


def test_what_can_be_split(abc):
    split = split_aggregates(abc, [("COUNT(*)", "n"), ("sum((a + 1) * e)", "s"), ("avg(a)", "m"), ("count(distinct c)", "d")])
    assert split.distinct == "c" and len(split.final) == 4
    assert split_aggregates(abc, [("count(distinct c)", "d"), ("count(distinct e)", "f")]) is None
    for expression in ("stddev(a)", "max(a) + stddev(a)", "sum(a) + sum(e)", "max(')')", "count(if(c = 'sum(', 1, null)) / count(*)", "2"):
        assert split_aggregates(abc, [(expression, "x")]) is not None
    # the same call twice is one aggregate; text is left alone, keys are renamed
    split = split_aggregates(abc, [("sum(a)", "x"), ("sum(a) + 1", "y")], "sum(a) > 1 and c <> 'c, (c)'", [("c", "__k0")])
    assert len(split.final) == 1 and "c, (c)" in str(split.having) and "__k0" in str(split.having)
