"""A corpus in random order, cut into shards: a shuffle in two passes that never holds more than a bucket.

Pass one scatters records into buckets by a seeded hash; there are as many buckets as it takes for
each to fit into a task's memory. Pass two loads one bucket at a time, puts it into an order
that the records alone decide, shuffles that by Fisher and Yates, and writes it. The buckets in order
are the shuffled corpus. A table of one row per bucket says where each starts, and shards are cuts of
that order into equal numbers of rows, so a shard is read from its own buckets only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.positions import block_carries
from ..session import fresh_path, materialise
from .common import free_name

# Bytes of text that a bucket should hold; a longer record is a bucket of its own size.
BUCKET_BYTES = 8 << 20
# Buckets in a row that one task writes, so that files hold runs of the order.
BLOCK_BUCKETS = 4
# Tasks of the second pass; beyond this many, each writes more buckets.
MAX_TASKS = 100_000
# Bytes a record counts beside its text.
RECORD_BYTES = 16


@dataclass(frozen=True)
class Shards:
    """Where a shuffled corpus lies, and how it is cut."""

    path: str
    n_shards: int
    n_rows: int

    def first(self, shard: int) -> int:
        """Rows before a shard: the first ``n_rows % n_shards`` shards hold one row more."""
        even, more = divmod(self.n_rows, self.n_shards)
        return shard * even + min(shard, more)


def record_size(text: Column) -> Column:
    """Bytes of a record: those of its text, and 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def _key(seed: int) -> Column:
    """A number that doc_id and text decide."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A random order of n places: from the last place down, each swaps with one not above it."""
    order = list(range(n))
    swaps = np.random.default_rng(seed).integers(0, np.arange(1, n + 1)).tolist()
    for last in range(n - 1, 0, -1):
        other = swaps[last]
        order[last], order[other] = order[other], order[last]
    return np.array(order, np.int64)


def write_shards(
    docs: DataFrame,
    n_shards: int,
    seed: int = 7,
    bucket_bytes: int = BUCKET_BYTES,
    path: str | None = None,
) -> Shards:
    """Write whole rows of ``docs`` in random order, to be read as ``n_shards`` shards.

    ``docs`` needs doc_id and text; all columns are written, whatever their names. Shards hold
    equal numbers of rows, but for one. The order depends on seed, doc_id and text: runs agree on
    any cluster as long as no two rows are equal in both. Rows that are equal are counted first and
    parted by their place in the input, so that a text that a third of all rows hold is spread over
    all buckets; such rows may swap places on another cluster. NULL doc_ids and texts count
    as values. An empty table gives shards without rows.

    The keys of all rows are written once (a number and a size each) to count bytes and repeats. The
    rows go through one shuffle, and one bucket at a time is in a task's memory.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark, names = docs.sparkSession, docs.columns
    key, lane = free_name(names, "__key"), free_name(names, "__lane")
    bucket, place = free_name(names, "__bucket"), free_name(names, "__place")
    block, twin = free_name(names, "__block"), free_name(names, "__twin")
    keys = materialise(
        docs.select(_key(seed).alias("key"), record_size(F.col("text")).alias("size")), "shard-keys"
    )
    n_rows, n_bytes = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    repeated = materialise(
        keys.groupBy("key").count().filter(F.col("count") > 1).select(F.col("key").alias(twin)),
        "shard-repeats",
    )
    n_buckets = max(1, -(-n_bytes // bucket_bytes))
    n_tasks = min(MAX_TASKS, -(-n_buckets // BLOCK_BUCKETS))
    # The number of a row is taken before the join, which may move rows.
    scattered = (
        docs.withColumn(key, _key(seed))
        .withColumn(lane, F.monotonically_increasing_id())
        .join(repeated, F.col(key) == F.col(twin), "left")
        .withColumn(lane, F.when(F.col(twin).isNotNull(), F.col(lane)).otherwise(-1))
        .drop(twin)
        .withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), key, lane), F.lit(n_buckets)))
        .withColumn(block, F.floor(F.col(bucket) * n_tasks / n_buckets).cast("int"))
    )
    kept = [f for f in scattered.schema.fields if f.name not in (key, lane, block)]
    schema = T.StructType([*kept, T.StructField(place, T.LongType())])

    def shuffle(table: pa.Table) -> pa.Table:
        own = table.column(bucket)[0].as_py()
        # The order that rows arrive in is not set; that of their keys is.
        ordered = table.sort_by([(key, "ascending"), (lane, "ascending"), ("doc_id", "ascending")])
        order = fisher_yates(table.num_rows, (seed, own))
        mixed = ordered.drop_columns([key, lane, block]).take(pa.array(order))
        return mixed.append_column(place, pa.array(np.arange(table.num_rows, dtype=np.int64)))

    path = path or fresh_path(spark, "shards")
    # A partition is a block of buckets, which serves the grouping too, sorted by bucket inside.
    shuffled = scattered.repartitionById(n_tasks, F.col(block)).groupBy(block, bucket).applyInArrow(shuffle, schema)
    renamed = shuffled.select(
        F.col(f"`{bucket}`").alias("bucket"),
        F.col(f"`{place}`").alias("place"),
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("record"),
    )
    renamed.write.parquet(f"{path}/records")
    written = spark.read.schema(renamed.schema).parquet(f"{path}/records")
    totals = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = block_carries(totals, "bucket", {"start": "n"})
    starts.select("bucket", F.col("start").cast("long").alias("start")).write.parquet(f"{path}/starts")
    shards = Shards(path, n_shards, n_rows)
    found = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if found != n_rows:
        raise RuntimeError(f"{n_rows} rows came in, {found} were written")
    return shards


def read_shards(spark: SparkSession, shards: Shards, shard: int | None = None) -> DataFrame:
    """All rows as (record, shard, slot), or those of one shard, read from its own buckets.

    Slots count from 0 in each shard. Order by slot for the shuffled order.
    """
    starts = spark.read.schema("bucket long, start long").parquet(f"{shards.path}/starts")
    records = spark.read.parquet(f"{shards.path}/records")
    if shard is not None:
        if not 0 <= shard < shards.n_shards:
            raise ValueError(f"there are shards 0 to {shards.n_shards - 1}")
        first, after = shards.first(shard), shards.first(shard + 1)
        begun = F.coalesce(F.max(F.when(F.col("start") <= first, F.col("bucket"))), F.lit(0))
        last = F.coalesce(F.max(F.when(F.col("start") < after, F.col("bucket"))), F.lit(0))
        low, high = starts.agg(begun, last).first()
        records = records.filter(F.col("bucket").between(low, high))
    even, more = divmod(shards.n_rows, shards.n_shards)
    # Shards before ``long`` rows hold one row more than the others.
    long = more * (even + 1)
    at = F.col("start") + F.col("place")
    of = F.when(at < long, F.floor(at / (even + 1))).otherwise(more + F.floor((at - long) / max(even, 1)))
    placed = records.join(starts, "bucket").select("record", of.cast("int").alias("shard"), at.alias("at"))
    begins = F.col("shard") * F.lit(even) + F.least(F.col("shard"), F.lit(more))
    found = placed.select("record", "shard", (F.col("at") - begins).cast("long").alias("slot"))
    return found if shard is None else found.filter(F.col("shard") == shard)


def shard_digests(spark: SparkSession, shards: Shards) -> DataFrame:
    """Per row, from the files: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    The law is ``rows``: numbers of rows differ by one at most, so no shard keeps its rows when there
    is one more, and grown_shard is NULL.
    """
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return read_shards(spark, shards).select(
        F.col("record.doc_id").cast("long").alias("doc_id"),
        record_size(F.col("record.text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
