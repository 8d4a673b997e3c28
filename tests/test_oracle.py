"""Every registered query against its SQL on an independent engine."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from askmill.workload.oracle import ORACLE
from askmill.workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_its_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())


def plain(row):
    return repr(tuple(0.0 if value == 0 and isinstance(value, float) else value for value in row))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    result = sql.execute(ORACLE[name])
    described = {column[0]: str(column[1]) for column in result.description}
    assert sorted(described) == columns
    assert {c: TYPES[t] for c, t in found.dtypes} == described
    at = [list(described).index(c) for c in columns]
    expected = sorted(plain([row[i] for i in at]) for row in result.fetchall())
    assert sorted(plain([row[c] for c in columns]) for row in found.collect()) == expected
    assert expected


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
