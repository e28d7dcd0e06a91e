"""Runs a corpus query and its SQL twin over tables of a folder, as the driver compares them."""

from __future__ import annotations

from pathlib import Path

import duckdb

import __spark_entry__ as contract
from tallyloom.llm import queries


def both(spark, name: str, folder) -> tuple[list, list]:
    """Sorted rows of the query and of its twin, columns by name; their types must agree."""
    table = contract.queries()[name](spark, str(folder))
    database = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else path
        database.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    result = database.execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(table.columns) == sorted(names)
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
    assert {c: kinds[t] for c, t in table.dtypes} == {d[0]: str(d[1]) for d in result.description}
    got = [tuple(row[c] for c in sorted(names)) for row in table.collect()]
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(row[i] for i in order) for row in result.fetchall()]
    return sorted(got, key=repr), sorted(want, key=repr)
