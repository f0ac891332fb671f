"""Queries of the corpus operators against their SQL, which shares no code with them."""

import os

import duckdb
import pytest

from paperloom.llm.oracle import ORACLES
from paperloom.llm.queries import QUERIES

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def folder():
    return os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, folder, name):
    database = duckdb.connect()
    for file in os.listdir(folder):
        database.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    found = QUERIES[name](spark, folder)
    cursor = database.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert {d[0]: TYPES[str(d[1])] for d in cursor.description} == dict(found.dtypes)
    rows = sorted(tuple(row[c] for c in names) for row in found.collect())
    assert rows == sorted(cursor.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
