"""Every catalog query against its SQL on the given tables."""

import os

import duckdb
import pytest

from paperloom.plans.catalog import QUERIES
from paperloom.plans.oracle import ORACLES

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def database(sf_folder):
    connection = duckdb.connect()
    for name in os.listdir(sf_folder):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_folder}/{name}'")
    return connection


@pytest.fixture(scope="module")
def sf_folder():
    return os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def _sortable(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, sf_folder, name):
    found = QUERIES[name](spark, sf_folder)
    columns = sorted(found.columns)
    rows = [tuple(row[c] for c in columns) for row in found.collect()]
    if name not in ORACLES:
        assert rows
        return
    cursor = database.execute(ORACLES[name])
    described = {d[0]: TYPES[str(d[1])] for d in cursor.description}
    assert described == dict(found.dtypes)
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    expected = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    assert sorted(rows, key=_sortable) == sorted(expected, key=_sortable)


def test_names():
    assert not set(ORACLES) - set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"recursive_chunks"}
