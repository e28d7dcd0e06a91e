"""What the operators share: reading tables, and cutting Arrow batches into bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Bytes of text that a task works on at once; one longer text is a piece of its own.
PIECE_BYTES = 2 << 20
# Texts of a piece, for work that numbers them in few bits.
PIECE_ROWS = 1 << 14


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each text of a column, 0 for a null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(
    batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``max_bytes`` of text and ``PIECE_ROWS`` rows."""
    for batch in batches:
        total = np.cumsum(row_bytes(batch.column(batch.schema.names.index(text))))
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = int(np.searchsorted(total, before + max_bytes, side="right"))
            stop = min(max(stop, start + 1), start + PIECE_ROWS)
            yield batch.slice(start, stop - start)
            start = stop


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with nulls as empty texts."""
    column = batch.column(batch.schema.names.index(name))
    return column.fill_null("") if column.null_count else column


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the offset of each text in it."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, starts, data = texts.buffers()
    offsets = np.frombuffer(starts, width)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_pieces(
    df: DataFrame, text: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]
) -> DataFrame:
    """Map pieces of a table in Arrow.

    ``make`` runs once in each task and returns the function that turns a batch into columns
    of the schema, so that models and vocabularies are loaded once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in pieces(batches, text):
            work = work or make()
            columns = work(batch)
            arrays = [pa.array(columns[f.name], type=f.type) for f in target]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)
