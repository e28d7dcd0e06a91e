"""One query per operator and per statistic. Each reads whole tables. Most stay lazy; readers
first write the file they read, and tables that are read twice are written once.

Computed doubles are rounded to eight decimals at the very end, because the order in which
an engine adds is its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from .. import sources as src
from ..plans import employment, estimates, occupancy, telework
from ..plans import fixed_values as fixed
from ..session import fresh_path, materialise
from . import views
from .views import LISTED_AREAS, TOTAL_ID, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def registered(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


def rounded(value: Column | str) -> Column:
    return F.round(value, 8)


def round_doubles(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    doubles = [n for n, t in df.dtypes if t == "double" and n not in skip]
    return df.withColumns({n: rounded(F.col(f"`{n}`")) for n in doubles})


# --- sources and sinks -------------------------------------------------------------------


@registered
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "orders-csv")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
        # Text that needs quoting, with blanks outside and inside, and a backslash.
        F.concat(F.lit('  a "'), "o_orderpriority", F.lit('",  b\\ ')).alias("label"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
    )
    src.write_report(orders, path)
    return src.read_typed_csv(
        spark, path, "o_orderkey BIGINT, o_orderdate DATE, label STRING, price DOUBLE", trim=False
    )


@registered
def tsv_trimmed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "customer-tsv")
    padded = table(spark, sf_dir, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 12, " ").alias("custkey"),
        F.rpad("c_name", 30, " ").alias("name"),
        F.concat(F.lit('  "'), "c_mktsegment", F.lit('"  \\" ')).alias("segment"),
        F.when(F.col("c_nationkey") != 7, F.lpad(F.col("c_nationkey").cast("string"), 3, "0"))
        .alias("nation"),
    )
    (
        padded.write.option("sep", "\t")
        .option("header", True)
        .option("nullValue", "")
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return src.read_trimmed_tsv(spark, path, ["custkey", "name", "segment", "nation"])


@registered
def fixed_width_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "persons-text")
    persons = views.persons(spark, sf_dir)
    widths = {"YEAR": 4, "MONTH": 2, "METFIPS": 5, "IND": 4, "TELWRKPAY": 1}
    persons.select(
        F.concat(
            *(F.lpad(F.col(name).cast("string"), width, " ") for name, width in widths.items()),
            F.lpad(F.col("WTFINL").cast("bigint").cast("string"), 6, " "),
        ).alias("value")
    ).write.text(path)
    layout = [
        ("YEAR", 1, 4, "int"),
        ("MONTH", 5, 6, "int"),
        ("METFIPS", 7, 11, "int"),
        ("IND", 12, 15, "int"),
        ("TELWRKPAY", 16, 16, "int"),
        ("WTFINL", 17, 22, "double"),
    ]
    return src.read_fixed_width(spark, path, layout)


@registered
def attach_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    pull = views.county_pull(spark, sf_dir)
    return round_doubles(
        op.attach_denominator(pull, fixed.WFH_VARIABLES, fixed.WORKERS_VARIABLE)
    )


@registered
def catalogue_from_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    return src.catalogue_from_match(catalogue, "p_partkey", "p_brand", "Brand#17")


# --- projections -------------------------------------------------------------------------


@registered
def rename_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_orderpriority", "o_totalprice")
        .withColumnsRenamed({"o_orderpriority": "Order Priority", "o_totalprice": "Total Price"})
    )


@registered
def select_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_name", "c_custkey")


@registered
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later columns use earlier ones; the price is exact in cents."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", price.alias("price"), "l_discount")
        .withColumn("saved", (F.col("price").cast("double") * F.col("l_discount")))
        .withColumn("paid", F.col("price").cast("double") - F.col("saved"))
        .select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            F.round("saved", 4).alias("saved"),
            F.round("paid", 4).alias("paid"),
        )
    )


@registered
def apply_to_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One function on every column but the key."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_discount", "l_tax"
    )
    return lines.select(
        "l_orderkey", *(F.round(F.col(c) * 100, 4).alias(c) for c in lines.columns[1:])
    )


@registered
def number_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes as text join a dimension that holds them as text."""
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey",
        (views.AREA_BASE + views.AREA_STEP * F.col("c_nationkey")).cast("string").alias("GEOID"),
    )
    return customer.join(views.areas(spark, sf_dir), "GEOID")


@registered
def recode_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = telework.with_supersector(views.persons(spark, sf_dir))
    name = op.label_codes(F.col("supersector_code"), fixed.SUPERSECTOR_NAMES)
    return sectors.select("IND", "supersector_code", name.alias("supersector_name"))


@registered
def recode_long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of 400 ranges: expanded to codes and joined on equality."""
    ranges = [(low, low + 19, f"band {low // 25}") for low in range(0, 10_000, 25)]
    return op.recode_ranges(
        views.persons(spark, sf_dir).select("IND", "WTFINL"), "IND", ranges, "band"
    )


@registered
def split_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.replace("o_orderpriority", F.lit("-"), F.lit("|"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", *fn.split_labels(label, ["priority_code", "priority_name"])
    )


@registered
def parse_fixed_width_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = views.series(spark, sf_dir)
    return series.select(
        "series_id", "period", "year", *fn.code_slices(F.col("series_id"), fixed.SERIES_LAYOUT)
    )


@registered
def safe_numeric_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    text = (
        F.when(F.col("l_returnflag") == "R", F.lit(" -"))
        .when(F.col("l_linestatus") == "O", F.concat(F.col("l_tax").cast("string"), F.lit("x")))
        .otherwise(F.lpad(F.col("l_quantity").cast("string"), 10, " "))
    )
    return lines.select("l_orderkey", "l_linenumber", fn.safe_double(text).alias("value"))


# --- filters -----------------------------------------------------------------------------


@registered
def filter_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = views.persons(spark, sf_dir)
    # A missing answer is neither in nor out of the universe and is dropped.
    answered = persons.withColumn(
        "TELWRKPAY", F.when(F.col("IND") >= 100, F.col("TELWRKPAY"))
    )
    return answered.filter(F.col("TELWRKPAY") != fixed.OUT_OF_UNIVERSE)


@registered
def filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keep_listed(views.persons(spark, sf_dir), "METFIPS", LISTED_AREAS)


@registered
def filter_in_long_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [str(code) for code in range(0, 9_900, 7)]
    return op.keep_listed(views.persons(spark, sf_dir), "IND", wanted)


@registered
def filter_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both bounds reach the scan of the ship date."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    kept = op.keep_dates(lines, "l_shipdate", *views.COMPARED_WEEKS)
    return kept.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@registered
def filter_not_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose weights sum to zero have no rate and are dropped."""
    tallies = telework.person_tallies(views.persons(spark, sf_dir))
    rates = op.share_rates(tallies, ["YEAR", "MONTH", "METFIPS", "IND"], "rate")
    return round_doubles(rates.filter(F.col("rate").isNotNull()))


@registered
def filter_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employment.annual_averages(
        views.series(spark, sf_dir), views.SERIES_YEAR, LISTED_AREAS
    )


@registered
def filter_after_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tallies = telework.person_tallies(
        telework.with_supersector(views.persons(spark, sf_dir))
    )
    rates = op.share_rates(tallies, ["supersector_code"], "rate")
    return round_doubles(rates.filter(F.col("supersector_code") != fixed.UNKNOWN_SECTOR))


@registered
def filter_after_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first weeks kept still see the weeks before the cut-off."""
    rolled = op.rolling_mean(
        views.supplier_panel(spark, sf_dir),
        ["l_suppkey"],
        "data_week",
        "occupancy",
        2,
        "mean2",
        axis=views.weeks(spark, sf_dir),
    )
    return round_doubles(
        rolled.filter(F.col("data_week") >= F.lit(views.FIRST_WEEK).cast("date"))
    )


# --- joins -------------------------------------------------------------------------------


@registered
def join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return op.join_lookup(customer, nation.select("c_nationkey", "n_name"), "c_nationkey")


@registered
def join_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return op.join_dimension(lines, supplier, "l_suppkey", "s_suppkey")


@registered
def join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables by a pair of keys that are both missing for codes of no sector."""
    persons = telework.with_supersector(views.persons(spark, sf_dir)).withColumn(
        "supersector_name",
        op.label_codes(F.col("supersector_code"), fixed.SUPERSECTOR_NAMES),
    )
    tallies = telework.person_tallies(persons)
    keys = ["supersector_code", "supersector_name"]
    focus = op.keep_listed(tallies, "METFIPS", [views.FOCUS_AREA])
    return round_doubles(
        op.join_null_safe(
            op.share_rates(focus, keys, "focus_rate"),
            op.share_rates(tallies, keys, "total_rate"),
            keys,
        )
    )


# --- aggregates --------------------------------------------------------------------------


@registered
def weighted_share_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    tallies = telework.person_tallies(views.persons(spark, sf_dir))
    return round_doubles(op.share_rates(tallies, ["IND", "METFIPS"], "rate"))


@registered
def weighted_share_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    tallies = telework.person_tallies(views.persons(spark, sf_dir))
    return round_doubles(op.total_rate(tallies, "METFIPS", TOTAL_ID, "rate"))


@registered
def mean_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity by part; one missing quantity makes a part's mean missing."""
    quantity = F.when(F.col("l_quantity") < 49, F.col("l_quantity"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", quantity.alias("quantity"))
    return round_doubles(op.mean_by_group(lines, ["l_partkey"], "quantity", "mean_quantity"))


@registered
def metro_and_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    tallies = telework.person_tallies(views.persons(spark, sf_dir))
    return round_doubles(
        op.rates_with_total(tallies, ["YEAR", "MONTH"], "METFIPS", LISTED_AREAS, TOTAL_ID, "rate")
    )


@registered
def grouped_with_missing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a sector form a group of their own."""
    tallies = telework.person_tallies(
        telework.with_supersector(views.persons(spark, sf_dir))
    )
    return round_doubles(
        op.share_rates(tallies, ["supersector_code", "YEAR"], "rate").orderBy(
            F.col("supersector_code").asc_nulls_last(), "YEAR"
        )
    )


@registered
def telework_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telework.telework_cube(views.persons(spark, sf_dir))


# --- windows and rows --------------------------------------------------------------------


@registered
def rolling_mean_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(
        op.rolling_mean(
            views.supplier_panel(spark, sf_dir),
            ["l_suppkey"],
            "data_week",
            "occupancy",
            fixed.ROLLING_WEEKS,
            "mean4",
            axis=views.weeks(spark, sf_dir),
        )
    )


@registered
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's share of its supplier's quantity: as many groups as suppliers."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"
    )
    return round_doubles(op.share_of_total(lines, ["l_suppkey"], "l_quantity", "share_pct"))


@registered
def order_series_by_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = op.latest_values(
        views.supplier_panel(spark, sf_dir), "l_suppkey", "data_week", "occupancy", "latest"
    )
    return round_doubles(op.sort_desc_nulls_last(latest, "latest", "l_suppkey"))


@registered
def row_mean_across_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all areas. The panel, a row for each week and area, is read three times."""
    panel = materialise(views.city_panel(spark, sf_dir), "city-panel")
    rolled = op.rolling_mean(
        panel, ["city"], "data_week", "occupancy", fixed.ROLLING_WEEKS, "mean4"
    )
    return round_doubles(
        op.row_mean_across_series(rolled, "city", "data_week", "mean4", "mean_of_cities", panel)
    )


# --- reshaping and order -----------------------------------------------------------------


@registered
def pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by supplier, a column per answer and linestatus; absent cells are missing."""
    long = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey"),
            week_of_shipping().alias("data_week"),
            F.concat("l_returnflag", "l_linestatus").alias("kind"),
        )
        .agg(F.sum("l_quantity").alias("quantity"))
    )
    return op.pivot_ordered(
        long, ["l_suppkey", "data_week"], "kind", "quantity", ["NO", "NF", "AO", "AF", "RO", "RF"]
    )


def week_of_shipping() -> Column:
    return fn.week_start(F.col("l_shipdate"))


def with_column_order(wide: DataFrame) -> DataFrame:
    """Adds the names of all columns but the first, in their order, so that it can be checked."""
    return wide.withColumn("column_order", F.lit("|".join(wide.columns[1:])))


@registered
def pivot_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in order of the code behind each name, not of the name; ``column_order`` has it."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).cast("int").alias("code"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("name"),
    )
    names = op.ordered_values(orders, "name", ["code"])
    counts = orders.groupBy("o_custkey", "name").agg(F.count(F.lit(1)).alias("n"))
    return with_column_order(op.pivot_ordered(counts, ["o_custkey"], "name", "n", names))


@registered
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), "c_mktsegment"
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")
    )
    return op.union_by_name(customer, supplier)


@registered
def sort_desc_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"))
    return op.sort_desc_nulls_last(orders, "price", "o_orderkey")


# --- scalar functions --------------------------------------------------------------------


@registered
def short_place_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.concat("p_brand", F.lit("-"), "p_type", F.lit(", "), "p_name")
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") <= 20, place)
        .when(F.col("p_size") <= 40, F.concat("p_name", F.lit(", A-B")))
        .otherwise(F.col("p_name"))
        .alias("place"),
    )
    return part.withColumn("short_name", fn.short_place_name(F.col("place")))


@registered
def year_month_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = views.persons(spark, sf_dir).select("YEAR", "MONTH", "METFIPS")
    date = fn.year_month_to_date(F.col("YEAR"), F.col("MONTH"))
    return persons.withColumn("date", date)


@registered
def period_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = views.series(spark, sf_dir).select("series_id", "year", "period")
    return series.withColumn("date", fn.period_to_date(F.col("year"), F.col("period")))


@registered
def ratio_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax as a percentage of the discount; lines without a discount have none."""
    lines = table(spark, sf_dir, "lineitem")
    pct = fn.ratio_pct(F.col("l_tax"), F.col("l_discount"))
    return lines.select("l_orderkey", "l_linenumber", rounded(pct).alias("pct"))


@registered
def moe_of_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forms of the formula, and missing margins, over every line item."""
    lines = table(spark, sf_dir, "lineitem")
    moe = fn.moe_of_proportion(
        F.col("l_quantity"),
        F.col("l_extendedprice"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity") * F.col("l_discount")),
        F.col("l_extendedprice") * (F.col("l_tax") + 0.005),
    )
    return lines.select("l_orderkey", "l_linenumber", rounded(moe * 100).alias("moe_pct"))


# --- whole statistics --------------------------------------------------------------------


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = views.area_sums(spark, sf_dir)
    return estimates.stacked_estimates(
        estimates.working_from_home(views.metro_pull(spark, sf_dir, sums)),
        estimates.working_from_home(views.total_pull(sums)),
    )


def _tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telework.person_tallies(views.persons(spark, sf_dir))


def _office_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telework.in_sectors(
        telework.person_tallies(telework.with_supersector(views.persons(spark, sf_dir))),
        fixed.OFFICE_SECTORS,
    )


@registered
def occupancy_weekly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.area_names(spark, sf_dir).filter(F.col("GEOID") != TOTAL_ID)
    cities = op.ordered_values(names, "msa_short_name", ["GEOID"])
    return round_doubles(
        occupancy.weekly_means_wide(
            op.keep_listed(views.city_panel(spark, sf_dir), "city", cities),
            cities,
            views.FIRST_WEEK,
            axis=views.weeks(spark, sf_dir),
        )
    )


@registered
def occupancy_columns_by_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel has a row per week; it is written once, for the order and for the result.

    ``column_order`` names the columns in their order.
    """
    return with_column_order(
        occupancy.columns_by_latest(
            materialise(occupancy_weekly_wide(spark, sf_dir), "weekly-wide")
        )
    )


@registered
def estimates_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(_estimates(spark, sf_dir))


@registered
def wfh_share_with_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = estimates.shares_with_bounds(
        _estimates(spark, sf_dir), [*LISTED_AREAS, "15460", TOTAL_ID]
    )
    return round_doubles(estimates.by_share(shares))


@registered
def telework_monthly_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = telework.monthly_rates(_tallies(spark, sf_dir), LISTED_AREAS)
    return round_doubles(telework.by_month(rates))


@registered
def telework_monthly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = telework.monthly_rates(_tallies(spark, sf_dir), LISTED_AREAS)
    return round_doubles(
        telework.monthly_rates_wide(rates, views.area_names(spark, sf_dir)).orderBy("date")
    )


@registered
def telework_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    tallies = telework.person_tallies(
        telework.with_supersector(views.persons(spark, sf_dir))
    )
    rates = telework.sector_rates(tallies, int(views.FOCUS_AREA), "focus", "total")
    return round_doubles(telework.by_total_rate(rates, "total"))


@registered
def office_telework_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = telework.area_rates(
        _office_tallies(spark, sf_dir), LISTED_AREAS, views.area_names(spark, sf_dir)
    )
    return round_doubles(telework.by_rate(rates))


@registered
def office_telework_monthly_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = telework.monthly_rates(_office_tallies(spark, sf_dir), LISTED_AREAS)
    return round_doubles(telework.by_month(rates))


@registered
def office_telework_monthly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = telework.monthly_rates(_office_tallies(spark, sf_dir), LISTED_AREAS)
    return round_doubles(
        telework.monthly_rates_wide(rates, views.area_names(spark, sf_dir)).orderBy("date")
    )


@registered
def employment_series_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employment.parsed_series(views.series(spark, sf_dir))


@registered
def employment_sector_share_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = materialise(
        employment.annual_averages(views.series(spark, sf_dir), views.SERIES_YEAR, LISTED_AREAS),
        "annual-averages",
    )
    names = views.area_names(spark, sf_dir)
    shares = employment.sector_shares(
        averages, names, views.supersectors(spark, sf_dir), views.COMPARED_AREAS
    )
    compared = op.keep_listed(names, "GEOID", views.COMPARED_AREAS)
    columns = op.ordered_values(compared, "msa_short_name", ["GEOID"])
    return round_doubles(employment.sector_shares_wide(shares, columns, columns[-1]))


@registered
def occupancy_and_telework(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = telework.area_rates(
        _office_tallies(spark, sf_dir), LISTED_AREAS, views.area_names(spark, sf_dir)
    )
    return round_doubles(
        occupancy.attendance_and_telework(
            views.city_panel(spark, sf_dir, views.COMPARED_WEEKS), rates, *views.COMPARED_WEEKS
        ).orderBy("city")
    )


@registered
def wfh_share_by_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = estimates.shares(
        estimates.working_from_home(views.county_pull(spark, sf_dir)), views.LISTED_SUPPLIERS
    )
    return round_doubles(estimates.by_share(shares))
