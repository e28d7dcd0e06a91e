"""Views of the driver's tables in the shape of the staged inputs.

The tables hold no survey data, so each input is derived from them, with every row used:

* persons: one per line item. Month from the ship date, area code from the supplier key
  (25 areas), industry code from the part key (spread over the whole code space, gaps and
  range ends included), answer from the return flag, weight from the quantity (0 without a
  discount). Like the real extract this is one flat table: no join, and a narrow scan.
* areas: nations with their region in the long name, and one row for the total.
* estimates: weighted line items per area or supplier, with margins as fixed fractions,
  chosen so that both forms of the margin formula occur.
* weekly panel: mean quantity by week of shipping and area.
* series: quantities by month and year under a 20-character identifier.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import short_place_name, week_start
from ..operators import keep_dates, union_by_name
from ..session import materialise

# Fixed values of the views, used by the SQL twins too.
N_AREAS = 25
AREA_BASE, AREA_STEP = 10_000, 420
LISTED_AREAS = [
    "10000",
    "10840",
    "12100",
    "12940",
    "13780",
    "14620",
    "15880",
    "17140",
    "18400",
    "19660",
]
FOCUS_AREA = "15880"
COMPARED_AREAS = ["10840", "12100", "14620", "15880"]
TOTAL_ID = "1"
TOTAL_NAME = "All Areas, Total"
LISTED_SUPPLIERS = [
    "000000003",
    "000000005",
    "000000007",
    "000000008",
    "000000013",
    "000000021",
    "000000034",
    "000000055",
    "000000089",
    "000000097",
    "000000098",
]
SUPPLIER_WITHOUT_ESTIMATE = 13
AREA_WITHOUT_ESTIMATE = 13
SECTOR_LOOKUP = [
    ("00", "Total Nonfarm"),
    ("05", "Total Private"),
    ("06", "Goods Producing"),
    ("07", "Service-Providing"),
    ("08", "Private Service Providing"),
    ("15", "Mining, Logging, and Construction"),
    ("20", "Construction"),
    ("30", "Manufacturing"),
    ("31", "Durable Goods"),
    ("32", "Non-Durable Goods"),
    ("40", "Trade, Transportation, and Utilities"),
    ("41", "Wholesale Trade"),
    ("42", "Retail Trade"),
    ("43", "Transportation and Utilities"),
    ("50", "Information"),
    ("55", "Financial Activities"),
    ("60", "Professional and Business Services"),
    ("65", "Education and Health Services"),
    ("70", "Leisure and Hospitality"),
    ("80", "Other Services"),
    ("90", "Government"),
]
SERIES_YEAR = "1998"
FIRST_WEEK = "1995-06-01"
COMPARED_WEEKS = ("1996-10-01", "1998-05-31")


TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
        "p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with its schema declared, which spares a job to look into the files."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def area_code(supplier_key: Column) -> Column:
    """Area code of a line item or supplier."""
    return (AREA_BASE + AREA_STEP * (supplier_key % N_AREAS)).cast("int")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = F.col("l_shipdate").cast("date")
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.year(shipped).alias("YEAR"),
        F.month(shipped).alias("MONTH"),
        area_code(F.col("l_suppkey")).alias("METFIPS"),
        ((F.col("l_partkey") * 10) % 9900).cast("int").alias("IND"),
        F.when(flag == "R", 1).when(flag == "A", 2).otherwise(0).alias("TELWRKPAY"),
        F.when(F.col("l_discount") == 0, F.lit(0.0))
        .otherwise(F.col("l_quantity"))
        .alias("WTFINL"),
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and long name of every area and of the total."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        (AREA_BASE + AREA_STEP * F.col("n_nationkey")).cast("string").alias("GEOID"),
        F.concat("n_name", F.lit("-"), "r_name", F.lit(", Metro Area")).alias("NAME"),
    )
    total = spark.range(1).select(F.lit(TOTAL_ID).alias("GEOID"), F.lit(TOTAL_NAME).alias("NAME"))
    return union_by_name(named, total)


def all_area_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area dimension with short names."""
    return areas(spark, sf_dir).withColumn("msa_short_name", short_place_name(F.col("NAME")))


def area_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area dimension of the listed areas and the total, with short names."""
    return all_area_names(spark, sf_dir).filter(F.col("GEOID").isin([*LISTED_AREAS, TOTAL_ID]))


def _variables(sums: DataFrame, keys: list[str], number: Column, missing: int) -> DataFrame:
    """Numerator and denominator rows of each geography, as a survey pull has them."""
    whole, part = F.col("whole"), F.when(number.isNull() | (number != missing), F.col("part"))
    margin = F.when(number % 2 == 0, whole * 0.9).otherwise(whole * 0.02)
    rows = F.array(
        F.struct(
            F.lit("B08006_001").alias("variable"), whole.alias("estimate"), margin.alias("moe")
        ),
        F.struct(
            F.lit("B08006_017").alias("variable"),
            part.alias("estimate"),
            (part * 0.05).alias("moe"),
        ),
    )
    return sums.select(*keys, F.explode(rows).alias("v")).select(*keys, "v.*")


def _weights() -> list[Column]:
    returned = F.col("l_returnflag") == "R"
    return [
        F.sum("l_quantity").alias("whole"),
        F.sum(F.when(returned, F.col("l_quantity")).otherwise(0.0)).alias("part"),
    ]


def _area_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("l_suppkey") % N_AREAS).alias("area_number")
    return table(spark, sf_dir, "lineitem").groupBy(number).agg(*_weights())


def area_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by area as a written table: one row per area, from one scan of the line items."""
    return materialise(_area_sums(spark, sf_dir), "area-sums")


def metro_pull(spark: SparkSession, sf_dir: str, sums: DataFrame) -> DataFrame:
    """Variables by area."""
    code = (AREA_BASE + AREA_STEP * F.col("area_number")).cast("string")
    named = sums.withColumn("GEOID", code).join(areas(spark, sf_dir), "GEOID")
    return _variables(named, ["GEOID", "NAME"], F.col("area_number"), AREA_WITHOUT_ESTIMATE)


def total_pull(sums: DataFrame) -> DataFrame:
    """Variables over all areas: sums of the areas' sums."""
    sums = (
        sums
        .agg(F.sum("whole").alias("whole"), F.sum("part").alias("part"))
        .withColumns({"GEOID": F.lit(TOTAL_ID), "NAME": F.lit(TOTAL_NAME)})
    )
    return _variables(sums, ["GEOID", "NAME"], F.lit(1), AREA_WITHOUT_ESTIMATE)


def county_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables by supplier, the finer geography."""
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(*_weights())
        .withColumns(
            {
                "GEOID": F.lpad(F.col("l_suppkey").cast("string"), 9, "0"),
                "NAME": F.concat(
                    F.lit("Supplier "), F.col("l_suppkey").cast("string"), F.lit(" County, Area")
                ),
            }
        )
    )
    return _variables(sums, ["GEOID", "NAME"], F.col("l_suppkey"), SUPPLIER_WITHOUT_ESTIMATE)


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week of every line item: a one-column scan that holds every date of the panels."""
    shipped = week_start(F.col("l_shipdate"))
    return table(spark, sf_dir, "lineitem").select(shipped.alias("data_week"))


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity by week and supplier: as many series as suppliers, with gaps."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(week_start(F.col("l_shipdate")).alias("data_week"), "l_suppkey")
        .agg(F.avg("l_quantity").alias("occupancy"))
    )


def city_panel(
    spark: SparkSession, sf_dir: str, weeks: tuple[str, str] | None = None
) -> DataFrame:
    """Mean quantity by week and area, under the area's short name.

    Rows are averaged by code; names join the averages. With ``weeks``, two dates, only weeks
    that start between them are averaged, and the range reaches the scan.
    """
    lines = table(spark, sf_dir, "lineitem")
    if weeks:
        # A week that starts on the last date holds the six days after it too.
        last = dt.date.fromisoformat(weeks[1]) + dt.timedelta(days=6)
        lines = keep_dates(lines, "l_shipdate", weeks[0], last.isoformat())
    means = (
        lines.groupBy(
            week_start(F.col("l_shipdate")).alias("data_week"),
            area_code(F.col("l_suppkey")).alias("code"),
        )
        .agg(F.avg("l_quantity").alias("occupancy"))
        .withColumn("GEOID", F.col("code").cast("string"))
    )
    names = all_area_names(spark, sf_dir).withColumnRenamed("msa_short_name", "city")
    return means.join(names, "GEOID").select("data_week", "city", "occupancy")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly and annual quantities per series, as padded text; small ones are withheld.

    Line items are added up under small numbers and flags; identifiers are spelled out on
    the sums. The annual rows are sums of the monthly table, not of the line items.
    """
    shipped = F.col("l_shipdate").cast("date")
    parts = {
        "area": (F.col("l_suppkey") % N_AREAS).cast("int"),
        "sector": (F.col("l_partkey") % len(SECTOR_LOOKUP)).cast("int"),
        "unadjusted": F.col("l_linestatus") == "F",
        "all_industries": F.col("l_tax") <= 0.04,
        "all_employees": F.col("l_linenumber") <= 4,
        "y": F.year(shipped),
    }
    monthly = (
        table(spark, sf_dir, "lineitem")
        .groupBy(*(column.alias(name) for name, column in parts.items()), F.month(shipped).alias("m"))
        .agg(F.sum("l_quantity").alias("q"))
    )
    annual = monthly.groupBy(*parts).agg(F.lit(13).alias("m"), F.sum("q").alias("q"))
    codes = F.array(*(F.lit(code) for code, _ in SECTOR_LOOKUP))
    identifier = F.concat(
        F.lit("SM"),
        F.when(F.col("unadjusted"), "U").otherwise("S"),
        F.lpad((F.col("area") + 1).cast("string"), 2, "0"),
        (AREA_BASE + AREA_STEP * F.col("area")).cast("string"),
        F.get(codes, F.col("sector")),
        F.when(F.col("all_industries"), "000000").otherwise("236000"),
        F.when(F.col("all_employees"), "01").otherwise("03"),
    )
    quantity = F.col("q").cast("bigint")
    text = F.when(quantity < 5, F.lit("-")).otherwise(quantity.cast("string"))
    return union_by_name(monthly, annual).select(
        identifier.alias("series_id"),
        F.col("y").cast("string").alias("year"),
        F.concat(F.lit("M"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("period"),
        F.lpad(text, 12, " ").alias("value"),
        F.lit(None).cast("string").alias("footnote_codes"),
    )


def supersectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supersector lookup: a literal relation whose size Spark knows."""
    rows = F.array(
        *(
            F.struct(F.lit(c).alias("supersector_code"), F.lit(n).alias("supersector_name"))
            for c, n in SECTOR_LOOKUP
        )
    )
    return spark.range(1).select(F.inline(rows))
