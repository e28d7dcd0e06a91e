"""A telework cube that is kept up to date month by month.

Microdata lies in folders by year and month. The store holds the cube's tallies of each month beside a
digest of the files they came from. A refresh lists the files, compares digests, and reads only the
months whose files are new or changed; every rate is a sum over the tallies of all months.

Tallies of a month are written under its digest, and a manifest names the digests that count. A new
manifest is one small file, written last, so readers see the old cube or the new one, and a
refresh that was cut off is simply run again: it overwrites the same partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import schemas
from .telework import telework_cube

_MONTH = ("YEAR", "MONTH")
_MANIFEST = "YEAR INT, MONTH INT, n_files BIGINT, n_bytes BIGINT, digest STRING, version INT"


def write_months(persons: DataFrame, path: str) -> None:
    """Write microdata by year and month, replacing the months that ``persons`` has, no others.

    Rows of a month go to as many tasks as Spark finds worth while, so a large month is many files.
    """
    missing = F.col("YEAR").isNull() | F.col("MONTH").isNull()
    lost = F.raise_error(F.lit("a person without a year or month")).cast("int")
    dated = persons.withColumn("YEAR", F.when(missing, lost).otherwise(F.col("YEAR")))
    (
        dated.repartition(*_MONTH, F.pmod(F.xxhash64(*persons.columns), F.lit(4)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*_MONTH)
        .parquet(path)
    )


def month_digests(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes and digest of each month: from the listing of the files, none of them opened.

    The digest is an exclusive or of hashes of path, length and time of change, in any order of files.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select(*(F.col(c).cast("int").alias(c) for c in _MONTH), "path", "length", "modificationTime")
    )

    def mixed(seed: int) -> Column:
        return F.hex(F.bit_xor(F.xxhash64(F.lit(seed), "path", "length", "modificationTime")))

    return files.groupBy(*_MONTH).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("length").alias("n_bytes"),
        F.concat(mixed(1), F.lit("-"), mixed(2)).alias("digest"),
    )


def _manifest(spark: SparkSession, store: str) -> DataFrame | None:
    """The newest manifest, or None for a new store."""
    try:
        every = spark.read.schema(_MANIFEST).parquet(f"{store}/manifest")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    newest = every.agg(F.max("version")).first()[0]
    return None if newest is None else every.filter(F.col("version") == newest)


def refresh_cube(
    spark: SparkSession,
    microdata: str,
    store: str,
    cube: Callable[[DataFrame], DataFrame] = telework_cube,
    schema: str = schemas.PERSONS,
) -> list[tuple[int, int]]:
    """Bring the store up to date with the microdata; returns the months it read.

    ``schema`` is that of the microdata; ``cube`` makes tallies of them that hold the columns YEAR
    and MONTH. If no file has changed, nothing is read or written. Months whose files are gone leave
    the cube. Refreshes of one store must not run at the same time.
    """
    # A row for each month of the calendar.
    found = month_digests(spark, microdata).collect()
    if any(row.YEAR is None or row.MONTH is None for row in found):
        raise ValueError("microdata without a year or month")
    known = _manifest(spark, store)
    old = {} if known is None else {(r.YEAR, r.MONTH): r.digest for r in known.collect()}
    new = {(r.YEAR, r.MONTH): r.digest for r in found}
    if known is not None and new == old:
        return []
    changed = sorted(month for month, digest in new.items() if old.get(month) != digest)
    if changed:
        # Year and month are folders, so this filter leaves out whole folders unread.
        here = (F.col("YEAR") * 100 + F.col("MONTH")).isin([y * 100 + m for y, m in changed])
        persons = spark.read.schema(schema).parquet(microdata).filter(here)
        digests = spark.createDataFrame([(*m, new[m]) for m in changed], "YEAR INT, MONTH INT, digest STRING")
        (
            cube(persons)
            .join(F.broadcast(digests), [*_MONTH])  # a row for each month of the calendar
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*_MONTH, "digest")
            .parquet(f"{store}/tallies")
        )
    version = 1 if known is None else known.agg(F.max("version")).first()[0] + 1
    rows = [(r.YEAR, r.MONTH, r.n_files, r.n_bytes, r.digest, version) for r in found]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").partitionBy(
        "version"
    ).parquet(f"{store}/manifest")
    return changed


def read_cube(spark: SparkSession, store: str) -> DataFrame:
    """The tallies of all months that the newest manifest names."""
    known = _manifest(spark, store)
    if known is None:
        raise ValueError(f"no cube in {store}")
    tallies = spark.read.option("basePath", f"{store}/tallies").parquet(f"{store}/tallies")
    valid = known.select(*_MONTH, "digest")
    return tallies.join(F.broadcast(valid), [*_MONTH, "digest"], "left_semi").drop("digest")
