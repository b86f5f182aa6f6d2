"""Every query against its SQL twin."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from workpulse.checks.oracle import SQL
from workpulse.checks.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _sorted_rows(rows):
    return sorted(rows, key=lambda row: tuple((value is None, str(value)) for value in row))


def _typed(rows):
    return [tuple((type(value), value) for value in row) for row in rows]


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert QUERIES.items() <= entry_points.queries().items() and SQL.items() <= entry_points.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(name, spark, duck, sf_dir):
    frame = QUERIES[name](spark, sf_dir)
    names = sorted(frame.columns)
    ours = _sorted_rows([tuple(row[column] for column in names) for row in frame.collect()])
    cursor = duck.execute(SQL[name])
    found = [column[0] for column in cursor.description]
    assert sorted(found) == names
    theirs = _sorted_rows([tuple(row[found.index(column)] for column in names) for row in cursor.fetchall()])
    assert ours
    assert _typed(ours) == _typed(theirs)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
