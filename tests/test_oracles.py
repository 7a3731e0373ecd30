"""Every registered query against its SQL in an independent engine."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}
#: Queries of the optional corpus subpackage are tested beside it.
CORPUS = {} if contract.corpus is None else {**contract.corpus.QUERIES, "pipeline": None}
QUERIES = {k: v for k, v in contract.queries().items() if k not in CORPUS}
ORACLES = {k: v for k, v in contract.oracle_sql().items() if k not in CORPUS}


@pytest.fixture(scope="module")
def engine(data):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, data, engine, name):
    df = QUERIES[name](spark, data)
    found = df.collect()
    answer = engine.execute(ORACLES[name])
    types = {column[0]: str(column[1]) for column in answer.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    order = sorted(types)
    place = {column[0]: i for i, column in enumerate(answer.description)}
    expected = sorted((tuple(r[place[c]] for c in order) for r in answer.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in order) for r in found), key=repr) == expected


def test_flagship_has_rows(spark):
    frame = contract.entry(spark)
    assert frame.columns[0] == "order_date"
    assert frame.count() > 0
