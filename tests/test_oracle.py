"""Every registered query agrees with its SQL equivalent."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from rtflow.examples import oracle as oracle_sql
from rtflow.examples import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("events", "customer", "orders")

# Queries of the llm subpackage, which may be absent, have tests of their own.
QUERIES = queries.queries()
ORACLE = oracle_sql.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables here")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


KINDS = {
    "boolean": "BOOLEAN",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    cursor = oracle.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]}) AS q")
    want_rows = cursor.fetchall()
    want_kinds = {column[0]: str(column[1]) for column in cursor.description}
    assert {c: KINDS[dict(got.dtypes)[c]] for c in columns} == want_kinds
    got_rows = Counter(tuple(row) for row in got.select(*columns).collect())
    want = Counter(want_rows)
    assert got_rows == want, f"missing {list((want - got_rows).items())[:3]}, extra {list((got_rows - want).items())[:3]}"
    if name != "ss_join_where":
        assert want
