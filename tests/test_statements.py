"""Every registered query against its SQL statement in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as spark_entry

SF_DIR = "/root/testdata/sf0.01"
STATEMENTS = spark_entry.statements()
QUERIES = {name: query for name, query in spark_entry.queries().items() if name in spark_entry._QUERIES}


@pytest.fixture(scope="module")
def database():
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
        yield connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value + 0.0)
        return repr(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    found = QUERIES[name](spark, SF_DIR)
    told = database.execute(STATEMENTS[name])
    columns = [c[0] for c in told.description]
    assert sorted(found.columns) == sorted(columns)
    expected = canonical(columns, told.fetchall())
    assert expected
    assert canonical(found.columns, [tuple(r) for r in found.collect()]) == expected


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 59
