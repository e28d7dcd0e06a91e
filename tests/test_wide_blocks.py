"""Blocks of columns against the long table they come from."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom import operators as op


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_cell_by_cell_and_aligned(spark):
    rows = [(i % 7 if i % 7 else None, f"n {i % 23}", i % 23 * -1, float(i)) for i in range(0, 160, 1) if i % 11]
    df = spark.createDataFrame(rows, "id int, name string, code int, x double").dropDuplicates(["id", "name"])
    df = spark.createDataFrame(df.collect(), df.schema)
    wide = op.pivot_blocks(df, ["id"], "name", "x", ["code"], block_columns=5)
    assert wide.n_blocks == 5
    assert rows_of(op.blocks_to_long(spark, wide, "name", "x")) == rows_of(df.select("id", "name", "x"))
    blocks = [spark.read.parquet(wide.block(k)) for k in range(5)]
    order = [c for b in blocks for c in b.columns[2:]]
    assert order == [f"n {i}" for i in range(22, -1, -1)]
    keys = [[(r.row, r.id) for r in b.select("row", "id").orderBy("row").collect()] for b in blocks]
    assert all(k == keys[0] for k in keys) and len(keys[0]) == 7
    want = {(r.id, r.name): r.x for r in df.collect()}
    for r in op.read_wide(spark, wide, ["n 3", "n 20", "n 4"]).collect():
        assert [r["n 3"], r["n 20"], r["n 4"]] == [want.get((r.id, n)) for n in ("n 3", "n 20", "n 4")]


def test_more_names_than_a_pivot_may_have(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 3).alias("id"),
        F.concat(F.lit("v"), F.floor(F.col("id") / 3)).alias("name"),
        F.when(F.col("id") % 5 != 0, F.col("id")).alias("x"),
    )
    assert 20_000 > int(spark.conf.get("spark.sql.pivotMaxValues"))
    wide = op.pivot_blocks(df, ["id"], "name", "x", block_columns=5_000)
    assert wide.n_blocks == 4
    long = op.blocks_to_long(spark, wide, "name", "x")
    want = df.filter("x is not null")
    assert long.exceptAll(want).count() == 0 and want.exceptAll(long).count() == 0


def test_wrong_rows_and_empty_tables(spark):
    def df(*rows):
        return spark.createDataFrame(rows, "id int, name string, x int")

    with pytest.raises(Exception, match="more than one row for a cell"):
        op.pivot_blocks(df((1, "a", 1), (1, "a", 2)), ["id"], "name", "x")
    with pytest.raises(Exception, match="a row without name"):
        op.pivot_blocks(df((1, None, 1)), ["id"], "name", "x")
    with pytest.raises(Exception, match="a column already"):
        op.pivot_blocks(df((1, "ID", 1)), ["id"], "name", "x")
    assert op.pivot_blocks(df(), ["id"], "name", "x").n_blocks == 0
    wide = op.pivot_blocks(df((1, "a`b.c", None), (2, "B", 5)), ["id"], "name", "x")
    assert rows_of(op.read_wide(spark, wide, ["a`b.c", "B"]).drop("row")) == [(1, None, None), (2, None, 5)]
    with pytest.raises(ValueError, match="no column"):
        op.read_wide(spark, wide, ["z"])
