"""Long to wide with more names than a table may have columns: blocks of columns aligned by row.

Names are numbered in their order and cut into blocks. Every block is a Parquet table of its own with a
real column for each of its names, the ids, and the number of the row, and all blocks hold all rows in
the same order. So blocks stand side by side like the pages of a wide sheet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, materialise
from .positions import with_positions

# Columns of a block. Spark plans some thousands of columns with ease.
BLOCK_COLUMNS = 1_000


def _column(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class WideBlocks:
    """Where the blocks lie. ``{path}/names`` says which column of which block holds a name."""

    path: str
    ids: tuple[str, ...]
    n_blocks: int

    def block(self, k: int) -> str:
        return f"{self.path}/block-{k:06d}"


def pivot_blocks(
    df: DataFrame,
    ids: Sequence[str],
    names_from: str,
    values_from: str,
    order_by: Sequence[str] = (),
    path: str | None = None,
    block_columns: int = BLOCK_COLUMNS,
) -> WideBlocks:
    """Write a long table as blocks of columns; absent cells are NULL.

    Names come in order of the least ``order_by`` they have, then by name. Two rows for one cell fail
    the query, and so does a row without a name or one with a name that would clash with an id or
    ``row``. Ids may be missing. Each block is one job over its own cells, so work grows with the
    cells, and no task holds more of a row than a block.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "wide-blocks")
    taken = [*(c.lower() for c in ids), "row"]
    name = F.col(f"`{names_from}`").cast("string")
    unnamed = F.raise_error(F.lit(f"a row without {names_from}")).cast("string")
    clash = F.raise_error(F.concat(F.lit("a name that is a column already: "), name)).cast("string")
    checked = F.when(name.isNull(), unnamed).when(F.lower(name).isin(taken), clash).otherwise(name)
    first = F.min(F.struct(*(F.col(f"`{c}`") for c in order_by), F.lit(0).alias("__0")))
    names = df.groupBy(checked.alias("name")).agg(first.alias("first"))
    names = with_positions(materialise(names, "wide-names"), ["first", "name"], "number").select(
        F.floor((F.col("number") - 1) / block_columns).cast("int").alias("block"),
        ((F.col("number") - 1) % block_columns).cast("int").alias("place"),
        "name",
    )
    names.write.parquet(f"{path}/names")
    names = spark.read.parquet(f"{path}/names")
    keys = [f"__id{i}" for i in range(len(ids))]
    long = df.select(
        *(F.col(f"`{c}`").alias(k) for c, k in zip(ids, keys)),
        name.alias("name"),
        F.col(f"`{values_from}`").alias("value"),
    )
    rows = with_positions(materialise(long.select(*keys).distinct(), "wide-rows"), keys, "row")
    rows = materialise(rows, "wide-rows")
    n_rows = rows.count()
    twice = F.raise_error(F.lit(f"more than one row for a cell of {values_from} by {names_from}"))
    one = F.when(F.count(F.lit(1)) <= 1, F.max("value")).otherwise(twice)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    placed = long.alias("l").join(rows.alias("r"), same).select("row", "name", "value")
    cells = placed.join(names, "name").groupBy("block", "row", "name").agg(one.alias("value"))
    cells.repartition("block", F.col("row") % 64).write.partitionBy("block").parquet(f"{path}/cells")
    stored = spark.read.schema(cells.schema).parquet(f"{path}/cells")
    n_blocks = (names.agg(F.max("block")).first()[0] or 0) + 1 if n_rows else 0
    wide = WideBlocks(path, tuple(ids), n_blocks)
    n_parts = max(1, min(n_rows, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    part = F.floor((F.col("row") - 1) * n_parts / max(1, n_rows)).cast("int")
    for k in range(n_blocks):
        own = [r.name for r in names.filter(F.col("block") == k).orderBy("place").collect()]
        own_cells = stored.filter(F.col("block") == k).select(F.col("row").alias("__row"), "name", "value")
        # Parts are ranges of the row number, the same in all blocks; a cell has one value by now.
        (
            rows.join(own_cells, F.col("row") == F.col("__row"), "left")
            .withColumn("__part", part)
            .repartitionById(n_parts, F.col("__part"))
            .groupBy("__part", "row", *(F.col(key).alias(c) for key, c in zip(keys, ids)))
            .pivot("name", own)
            .agg(F.first("value"))
            .drop("__part")
            .sortWithinPartitions("row")
            .write.parquet(wide.block(k))
        )
    return wide


def read_wide(spark: SparkSession, wide: WideBlocks, names: Sequence[str]) -> DataFrame:
    """Row number, ids and the named columns, from the blocks that hold them, joined by row."""
    table = spark.read.parquet(f"{wide.path}/names")
    of = {r.name: r.block for r in table.filter(F.col("name").isin(list(names))).collect()}
    if missing := [n for n in names if n not in of]:
        raise ValueError(f"no column is named {missing}")
    blocks = sorted(set(of.values())) or [0]
    result = None
    for k in blocks:
        own = [_column(n) for n in dict.fromkeys(names) if of[n] == k]
        part = spark.read.parquet(wide.block(k))
        ids = [F.col(f"`{c}`") for c in wide.ids] if result is None else []
        part = part.select("row", *ids, *own)
        result = part if result is None else result.join(part, "row")
    return result.select("row", *(_column(c) for c in (*wide.ids, *names)))


def blocks_to_long(spark: SparkSession, wide: WideBlocks, names_to: str, values_to: str) -> DataFrame:
    """The long table again: a row for each cell that is not missing."""
    names = spark.read.parquet(f"{wide.path}/names")
    result = None
    for k in range(wide.n_blocks):
        block = spark.read.parquet(wide.block(k))
        cells = F.posexplode(F.array(*(_column(c) for c in block.columns[1 + len(wide.ids) :])))
        part = block.select(
            *(F.col(f"`{c}`") for c in wide.ids), F.lit(k).alias("block"), cells.alias("place", values_to)
        )
        result = part if result is None else result.unionByName(part)
    if result is None:
        raise ValueError("there are no blocks")
    return (
        result.filter(F.col(values_to).isNotNull())
        .join(names, ["block", "place"])
        .select(*(F.col(f"`{c}`") for c in wide.ids), F.col("name").alias(names_to), values_to)
    )
