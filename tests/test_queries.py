"""Every registered query at the smallest scale; with its SQL where it has one."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small_dir}/{table}.parquet'")
    return con


def ordered(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        return repr(float(value)) if isinstance(value, float) else repr(value)

    return sorted(tuple(plain(row[i]) for i in places) for row in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small_dir, duck, name):
    result = QUERIES[name](spark, small_dir)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    assert ordered(result.collect(), result.columns) == ordered(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, small_dir, name):
    rows = QUERIES[name](spark, small_dir).collect()
    assert rows
    for row in rows:
        assert not any(isinstance(v, float) and math.isinf(v) for v in row)
