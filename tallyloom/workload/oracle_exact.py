"""SQL twins of the exact queries: sums of 128-bit whole numbers, turned into doubles once.

Values are multiples of a small power of two, so scaled by it they are whole. A whole number
goes to the nearest double through its decimal text.
"""

from __future__ import annotations

from ..plans import fixed_values as fixed
from .oracle import CITY_PANEL, ORACLE, PERSONS, SUPPLIER_PANEL
from .queries_exact import LONG_WINDOW
from .views import TOTAL_ID


def _exact(aggregate: str, value: str, bits: int) -> str:
    """An aggregate, with ``{}`` for its argument, of values that are multiples of 2 ** -bits."""
    whole = aggregate.format(f"CAST(({value}) * CAST({2**bits} AS DOUBLE) AS HUGEINT)")
    return f"(CAST(CAST({whole} AS VARCHAR) AS DOUBLE) / CAST({2**bits} AS DOUBLE))"


def _sum(value: str, bits: int) -> str:
    return _exact("sum({})", value, bits)


_WEIGHT = "WTFINL / CAST(7 AS DOUBLE)"
_YES = f"CASE WHEN TELWRKPAY = 1 THEN {_WEIGHT} ELSE CAST(0 AS DOUBLE) END"
_SHARE = f"{_sum(_YES, 56)} / nullif({_sum(_WEIGHT, 56)}, 0)"
_PRICE = "l_extendedprice / CAST(3 AS DOUBLE)"


def _dense_exact(series: str, k: int) -> str:
    mean = _exact("sum({}) OVER f", "occupancy", 50)
    return f"""dense AS (
  SELECT s.{series}, w.data_week, p.occupancy
  FROM (SELECT DISTINCT {series} FROM panel) s CROSS JOIN (SELECT DISTINCT data_week FROM panel) w
  LEFT JOIN panel p ON p.{series} = s.{series} AND p.data_week = w.data_week),
rolled AS (
  SELECT {series}, data_week, occupancy,
         CASE WHEN count(occupancy) OVER f = {k} THEN {mean} / {k} END AS mean4
  FROM dense WINDOW f AS (PARTITION BY {series} ORDER BY data_week
                          ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW))"""


ORACLE |= {
    "exact_weighted_share_by_group": f"""WITH {PERSONS}
        SELECT IND, METFIPS, {_SHARE} AS rate FROM persons WHERE TELWRKPAY <> 0
        GROUP BY IND, METFIPS""",
    "exact_weighted_share_global": f"""WITH {PERSONS}
        SELECT '{TOTAL_ID}' AS METFIPS, {_SHARE} AS rate FROM persons WHERE TELWRKPAY <> 0""",
    "exact_sums_by_supplier": f"""
        SELECT l_suppkey, {_sum('l_extendedprice * l_quantity', 60)} AS sum_value,
               {_sum('l_tax / CAST(1024000 AS DOUBLE)', 80)} AS sum_small
        FROM lineitem GROUP BY l_suppkey""",
    "exact_mean_by_group": f"""
        SELECT l_partkey, CASE WHEN count(price) = count(*) THEN {_sum('price', 50)} / count(*) END
               AS mean_price
        FROM (SELECT l_partkey, CASE WHEN l_quantity < 49 THEN {_PRICE} END AS price FROM lineitem)
        GROUP BY l_partkey""",
    "exact_rolling_mean_trailing": f"""WITH {SUPPLIER_PANEL},
        {_dense_exact('l_suppkey', fixed.ROLLING_WEEKS)}
        SELECT data_week, l_suppkey, occupancy, mean4 FROM rolled WHERE occupancy IS NOT NULL""",
    "exact_row_mean_across_series": f"""WITH {CITY_PANEL},
        {_dense_exact('city', fixed.ROLLING_WEEKS)}
        SELECT data_week, CASE WHEN count(mean4) = (SELECT count(DISTINCT city) FROM panel)
                               THEN {_sum('mean4', 50)} / count(mean4) END AS mean_of_cities
        FROM (SELECT * FROM rolled WHERE occupancy IS NOT NULL) GROUP BY data_week""",
    "trailing_mean_long": f"""WITH cells AS (
          SELECT CASE WHEN o_orderkey % 4 = 3 THEN 'some' ELSE 'most' END AS series,
                 CASE WHEN o_orderkey % 4 = 3 THEN o_orderkey // 4
                      ELSE o_orderkey - o_orderkey // 4 END AS position,
                 CASE WHEN o_orderkey % 3301 <> 0 THEN o_totalprice / CAST(7 AS DOUBLE) END AS price
          FROM orders WHERE o_orderkey % 4999 <> 0)
        SELECT series, position, price,
               CASE WHEN count(price) OVER f = {LONG_WINDOW}
                    THEN {_exact('sum({}) OVER f', 'price', 50)} / {LONG_WINDOW} END AS mean
        FROM cells WINDOW f AS (PARTITION BY series ORDER BY position
                                RANGE BETWEEN {LONG_WINDOW - 1} PRECEDING AND CURRENT ROW)""",
    "range_lookup_table": """
        WITH ranges AS (
          SELECT o_orderkey * 100 AS low, o_orderkey * 100 + o_orderkey % 90 AS high,
                 o_orderpriority AS label, o_custkey AS owner FROM orders
          UNION ALL SELECT -2147483648, -1, 'wide', NULL),
        lines AS (
          SELECT l_orderkey, l_linenumber,
                 CASE WHEN l_returnflag = 'R' THEN -l_partkey * 10000019
                      WHEN l_tax > 0 THEN l_orderkey * 100 + l_partkey % 100 END AS code
          FROM lineitem)
        SELECT l_orderkey, l_linenumber, code, label, owner
        FROM lines LEFT JOIN ranges ON code BETWEEN low AND high""",
}
