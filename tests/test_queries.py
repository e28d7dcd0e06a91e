"""Every registered query against its SQL twin, as the driver compares them."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tallyloom.workload.oracle import ORACLE
from tallyloom.workload.queries import REGISTRY
from conftest import TEST_DATA

duckdb = pytest.importorskip("duckdb")
SMALL = TEST_DATA / "sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}

pytestmark = pytest.mark.skipif(not SMALL.is_dir(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def sortable(rows, order):
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, database, name):
    table = contract.queries()[name](spark, str(SMALL))
    result = database.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    assert sorted(table.columns) == sorted(names)
    assert {c: TYPES[t] for c, t in table.dtypes} == types
    by_name = sorted(names)
    got = sortable(table.collect(), [table.columns.index(c) for c in by_name])
    want = sortable(result.fetchall(), [names.index(c) for c in by_name])
    assert got == want


def test_every_query_has_a_twin():
    assert set(REGISTRY) == set(ORACLE)
    assert REGISTRY.keys() <= contract.queries().keys()


def test_entry(spark):
    table = contract.entry(spark)
    assert table.columns[0] == "date" and table.count() > 0
