"""Queries over what the library writes and keeps: text files in splits, cubes by month, wide blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from .. import sources as src
from ..plans import cube_store, telework
from ..session import fresh_path
from . import views
from .queries import registered
from .views import table

# Columns of a block in the query, and the month that is written wrong first.
BLOCK_COLUMNS = 500
CORRECTED = (1995, 6)
WANTED = "Brand#17"


def _written_catalogue(spark: SparkSession, sf_dir: str) -> str:
    """The parts as text without an ordinal, in several files; every third name has a line break."""
    path = fresh_path(spark, "part-csv")
    broken = F.concat("p_name", F.lit('\n"'), "p_type", F.lit('",'))
    (
        table(spark, sf_dir, "part")
        .select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 == 0, broken).otherwise(F.col("p_name")).alias("p_name"))
        .repartitionByRange(3, "p_partkey")
        .sortWithinPartitions("p_partkey")
        .drop("p_partkey")
        .write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return path


@registered
def quoted_csv_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that span lines, read in splits, numbered in the order of their files."""
    path = _written_catalogue(spark, sf_dir)
    records = src.read_quoted_csv(
        spark, path, "p_brand STRING, p_name STRING", trim=False, position="at"
    )
    return op.with_positions(records, ["at"], "entry").drop("at")


@registered
def catalogue_without_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries from the first one of a brand on, by the places of their lines."""
    path = _written_catalogue(spark, sf_dir)
    catalogue = src.read_quoted_csv(
        spark, path, "p_brand STRING, p_name STRING", trim=False, position="at"
    )
    found = src.catalogue_from_match(catalogue, "at", "p_brand", WANTED)
    return op.with_positions(found, ["at"], "entry").drop("at")


@registered
def telework_cube_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube after a first build, a correction of one month and the addition of a year."""
    microdata, store = fresh_path(spark, "microdata"), fresh_path(spark, "cube")
    persons = views.persons(spark, sf_dir)
    year, month = CORRECTED
    late = F.col("YEAR") >= 1998
    corrected = (F.col("YEAR") == year) & (F.col("MONTH") == month)
    wrong = F.when(corrected, F.col("WTFINL") * 3).otherwise(F.col("WTFINL"))
    cube_store.write_months(persons.filter(~late).withColumn("WTFINL", wrong), microdata)
    cube_store.refresh_cube(spark, microdata, store)
    cube_store.write_months(persons.filter(late | corrected), microdata)
    cube_store.refresh_cube(spark, microdata, store)
    return cube_store.read_cube(spark, store)


@registered
def pivot_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by supplier, a column for each day, in blocks of columns; read back as a long table."""
    day = F.col("l_shipdate").cast("date").cast("string")
    long = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", day.alias("day"))
        .agg(F.sum("l_quantity").alias("quantity"))
    )
    wide = op.pivot_blocks(long, ["l_suppkey"], "day", "quantity", block_columns=BLOCK_COLUMNS)
    names = spark.read.parquet(f"{wide.path}/names").withColumnRenamed("name", "day")
    found = op.blocks_to_long(spark, wide, "day", "quantity")
    place = (F.col("block") * BLOCK_COLUMNS + F.col("place")).cast("long").alias("column_number")
    return found.join(names, "day").select("l_suppkey", "day", "quantity", place)


@registered
def join_null_safe_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of each area and sector beside the area's first lines, many of them under no sector."""
    persons = telework.with_supersector(views.persons(spark, sf_dir)).select(
        F.when(F.col("IND") % 3 != 0, F.col("supersector_code")).alias("sector"),
        F.when(F.col("IND") % 3 != 0, F.col("METFIPS")).alias("area"),
        "YEAR",
        "WTFINL",
    )
    weights = persons.groupBy("sector", "area", "YEAR").agg(F.sum("WTFINL").alias("weight"))
    joined = op.join_null_safe_hot(persons.drop("YEAR"), weights, ["sector", "area"], 500)
    return joined.groupBy("sector", "area").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(F.col("WTFINL") * F.col("weight")).alias("product")
    )
