"""SQL twins of the queries, over the same tables.

They are written the plain way on purpose: dense grids, joins on ranges, windows, two scans
for areas and total. The queries must give the same rows by their own route.
"""

from __future__ import annotations

from ..plans import fixed_values as fixed
from . import views


def _texts(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _numbers(values) -> str:
    return ", ".join(str(v) for v in values)


def _rows(rows) -> str:
    def literal(value):
        return str(value) if isinstance(value, int) else _texts([value])

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


AREA_CODE = f"CAST({views.AREA_BASE} + {views.AREA_STEP} * (l_suppkey % {views.N_AREAS}) AS INTEGER)"
WEEK = "CAST(date_trunc('week', l_shipdate) AS DATE)"

PERSONS = f"""persons AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS YEAR, CAST(month(l_shipdate) AS INTEGER) AS MONTH,
         {AREA_CODE} AS METFIPS, CAST((l_partkey * 10) % 9900 AS INTEGER) AS IND,
         CAST(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS INTEGER) AS TELWRKPAY,
         CASE WHEN l_discount = 0 THEN CAST(0 AS DOUBLE) ELSE l_quantity END AS WTFINL
  FROM lineitem)"""

SECTORED = f"""{PERSONS},
ranges(lo, hi, code) AS (VALUES {_rows(fixed.SUPERSECTOR_RANGES)}),
sector_names(code, name) AS (VALUES {_rows(fixed.SUPERSECTOR_NAMES.items())}),
sectored AS (
  SELECT p.*, r.code AS supersector_code, n.name AS supersector_name
  FROM persons p LEFT JOIN ranges r ON p.IND BETWEEN r.lo AND r.hi
  LEFT JOIN sector_names n ON n.code = r.code)"""

SHARE = "sum(CASE WHEN TELWRKPAY = 1 THEN WTFINL ELSE 0 END) / nullif(sum(WTFINL), 0)"

AREAS = f"""areas AS (
  SELECT CAST({views.AREA_BASE} + {views.AREA_STEP} * n_nationkey AS VARCHAR) AS GEOID,
         n_name || '-' || r_name || ', Metro Area' AS NAME
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT '{views.TOTAL_ID}', '{views.TOTAL_NAME}'),
area_names AS (
  SELECT GEOID, NAME,
         regexp_replace(regexp_replace(NAME, '-.*$', ''), ',.*$', '') AS msa_short_name
  FROM areas WHERE GEOID IN ({_texts([*views.LISTED_AREAS, views.TOTAL_ID])}))"""


def _variables(keys: str, number: str, missing: int, source: str) -> str:
    """Numerator and denominator rows, already joined: one row per geography."""
    return f"""
  SELECT {keys}, 'wfh' AS variable,
         CASE WHEN {number} = {missing} THEN NULL ELSE part END AS estimate,
         CASE WHEN {number} = {missing} THEN NULL ELSE part END * CAST(0.05 AS DOUBLE) AS moe,
         whole AS summary_est,
         whole * CASE WHEN {number} % 2 = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.02 AS DOUBLE) END
           AS summary_moe
  FROM ({source})"""


_WEIGHTS = (
    "sum(l_quantity) AS whole, "
    "sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE CAST(0 AS DOUBLE) END) AS part"
)
METRO = _variables(
    "GEOID, NAME",
    "number",
    views.AREA_WITHOUT_ESTIMATE,
    f"""SELECT s.*, a.GEOID, a.NAME FROM
        (SELECT l_suppkey % {views.N_AREAS} AS number, {_WEIGHTS} FROM lineitem GROUP BY 1) s
        JOIN areas a ON a.GEOID = CAST({views.AREA_BASE} + {views.AREA_STEP} * number AS VARCHAR)""",
)
TOTAL = _variables(
    f"'{views.TOTAL_ID}' AS GEOID, '{views.TOTAL_NAME}' AS NAME",
    "1",
    views.AREA_WITHOUT_ESTIMATE,
    f"SELECT {_WEIGHTS} FROM lineitem",
)
COUNTY = _variables(
    "lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS GEOID, "
    "'Supplier ' || CAST(l_suppkey AS VARCHAR) || ' County, Area' AS NAME",
    "l_suppkey",
    views.SUPPLIER_WITHOUT_ESTIMATE,
    f"SELECT l_suppkey, {_WEIGHTS} FROM lineitem GROUP BY 1",
)
ESTIMATES = f"{AREAS}, estimates AS ({METRO} UNION ALL {TOTAL})"

SERIES = f"""lookup(position, supersector_code, supersector_name) AS (VALUES {_rows(
    (i, code, name) for i, (code, name) in enumerate(views.SECTOR_LOOKUP))}),
identified AS (
  SELECT 'SM' || CASE WHEN l_linestatus = 'F' THEN 'U' ELSE 'S' END
         || lpad(CAST(l_suppkey % {views.N_AREAS} + 1 AS VARCHAR), 2, '0')
         || CAST({AREA_CODE} AS VARCHAR) || k.supersector_code
         || CASE WHEN l_tax <= 0.04 THEN '000000' ELSE '236000' END
         || CASE WHEN l_linenumber <= 4 THEN '01' ELSE '03' END AS series_id,
         year(l_shipdate) AS y, month(l_shipdate) AS m, l_quantity
  FROM lineitem JOIN lookup k ON k.position = l_partkey % {len(views.SECTOR_LOOKUP)}),
summed AS (
  SELECT series_id, y, m, sum(l_quantity) AS q FROM identified GROUP BY 1, 2, 3
  UNION ALL SELECT series_id, y, 13, sum(l_quantity) FROM identified GROUP BY 1, 2),
series AS (
  SELECT series_id, CAST(y AS VARCHAR) AS year, 'M' || lpad(CAST(m AS VARCHAR), 2, '0') AS period,
         lpad(CASE WHEN q < 5 THEN '-' ELSE CAST(CAST(q AS BIGINT) AS VARCHAR) END, 12, ' ') AS value,
         CAST(NULL AS VARCHAR) AS footnote_codes
  FROM summed)"""

_SLICES = ", ".join(
    f"substring(series_id, {first}, {last - first + 1}) AS {name}"
    for name, first, last in fixed.SERIES_LAYOUT
)
PARSED = f"""{SERIES}, parsed AS (
  SELECT series_id, year, period, TRY_CAST(trim(value) AS DOUBLE) AS value, footnote_codes, {_SLICES},
         CAST(try_strptime(year || '-' || substring(period, 2, 2) || '-01', '%Y-%m-%d') AS DATE) AS date
  FROM series),
averages AS (
  SELECT * FROM parsed
  WHERE period = 'M13' AND year = '{views.SERIES_YEAR}' AND naics_code = '000000'
    AND seas_adj = 'U' AND measure_code = '01' AND area_code IN ({_texts(views.LISTED_AREAS)}))"""

SUPPLIER_PANEL = f"""panel AS (
  SELECT {WEEK} AS data_week, l_suppkey, avg(l_quantity) AS occupancy FROM lineitem GROUP BY 1, 2)"""
CITY_PANEL = f"""{AREAS}, panel AS (
  SELECT data_week, msa_short_name AS city, occupancy FROM
    (SELECT {WEEK} AS data_week, CAST({AREA_CODE} AS VARCHAR) AS GEOID,
            avg(l_quantity) AS occupancy FROM lineitem GROUP BY 1, 2)
    JOIN (SELECT GEOID, regexp_replace(regexp_replace(NAME, '-.*$', ''), ',.*$', '') AS msa_short_name
          FROM areas) USING (GEOID)),
weeks AS (SELECT DISTINCT {WEEK} AS data_week FROM lineitem)"""


def _dense_mean(series: str, k: int, weeks: str, out: str) -> str:
    """Trailing mean over the full grid of series and weeks; cells without input dropped."""
    return f"""dense AS (
  SELECT s.{series}, w.data_week, p.occupancy
  FROM (SELECT DISTINCT {series} FROM panel) s CROSS JOIN {weeks} w
  LEFT JOIN panel p ON p.{series} = s.{series} AND p.data_week = w.data_week),
rolled AS (
  SELECT {series}, data_week, occupancy,
         CASE WHEN count(occupancy) OVER f = {k} THEN avg(occupancy) OVER f END AS {out}
  FROM dense WINDOW f AS (PARTITION BY {series} ORDER BY data_week
                          ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW))"""


_ROUND = "round({}, 8)"


def _monthly(source: str, extra: str = "") -> str:
    where = f"WHERE TELWRKPAY <> 0 {extra}"
    return f"""
  SELECT YEAR, MONTH, CAST(METFIPS AS VARCHAR) AS METFIPS, {SHARE} AS wfh_pct FROM {source}
  {where} AND METFIPS IN ({_numbers(views.LISTED_AREAS)}) GROUP BY YEAR, MONTH, METFIPS
  UNION ALL
  SELECT YEAR, MONTH, '{views.TOTAL_ID}', {SHARE} FROM {source} {where} GROUP BY YEAR, MONTH"""


_OFFICE = f"AND supersector_code IN ({_texts(fixed.OFFICE_SECTORS)})"
_LISTED_SHORT = [f"NATION_{(int(a) - views.AREA_BASE) // views.AREA_STEP}" for a in views.LISTED_AREAS]
_TOTAL_SHORT = views.TOTAL_NAME.split(",")[0]


def _monthly_wide(with_: str, monthly: str) -> str:
    cells = ", ".join(
        f"""max(CASE WHEN msa_short_name = '{n}' THEN round(wfh_pct * 100, 8) END) AS "{n}\""""
        for n in [*_LISTED_SHORT, _TOTAL_SHORT]
    )
    return f"""WITH {with_}, {AREAS}, monthly AS ({monthly})
  SELECT make_date(YEAR, MONTH, 1) AS date, {cells}
  FROM monthly JOIN area_names ON METFIPS = GEOID WHERE wfh_pct IS NOT NULL GROUP BY 1"""


def _area_rates() -> str:
    where = f"WHERE TELWRKPAY <> 0 {_OFFICE}"
    return f"""
  SELECT r.METFIPS, 100 * r.rate AS wfh_pct, a.NAME, a.msa_short_name FROM (
    SELECT CAST(METFIPS AS VARCHAR) AS METFIPS, {SHARE} AS rate FROM sectored
    {where} AND METFIPS IN ({_numbers(views.LISTED_AREAS)}) GROUP BY 1
    UNION ALL SELECT '{views.TOTAL_ID}', {SHARE} FROM sectored {where}) r
  JOIN area_names a ON a.GEOID = r.METFIPS"""


def _weekly_wide() -> str:
    cells = ", ".join(
        f"""round(max(CASE WHEN city = '{n}' THEN mean4 END), 8) AS "{n}\"""" for n in _LISTED_SHORT
    )
    n = len(_LISTED_SHORT)
    return f"""WITH {CITY_PANEL}, {_dense_mean('city', 4, 'weeks', 'mean4')}
  SELECT data_week, {cells},
         round(CASE WHEN count(mean4) = {n} THEN sum(mean4) / {n} END, 8) AS "{fixed.MEAN_OF_METROS}"
  FROM rolled WHERE data_week >= DATE '{views.FIRST_WEEK}' AND city IN ({_texts(_LISTED_SHORT)})
  GROUP BY data_week"""


def _columns_by_latest() -> str:
    """The same with the order of its columns, from the values of the newest week."""
    mean = fixed.MEAN_OF_METROS
    names = [*_LISTED_SHORT, mean]
    newest = " UNION ALL ".join(
        f"""SELECT '{n}' AS name, {i} AS place, "{n}" AS value FROM newest""" for i, n in enumerate(names)
    )
    return f"""WITH wide AS ({_weekly_wide()}),
newest AS (SELECT * FROM wide ORDER BY data_week DESC LIMIT 1),
columns AS ({newest})
SELECT wide.*, (SELECT string_agg(name, '|' ORDER BY value DESC NULLS LAST, place) FROM columns) AS column_order
FROM wide"""


_MOE_INNER = """SELECT *, estimate / nullif(summary_est, 0) AS p FROM ({})"""


def _bounds(source: str) -> str:
    radicand = "moe * moe - p * p * summary_moe * summary_moe"
    return f"""
  SELECT GEOID, NAME, regexp_replace(regexp_replace(NAME, '-.*$', ''), ',.*$', '') AS msa_short_name,
         round(100 * p, 8) AS wfh_prop, round(100 * p - 100 * margin, 8) AS wfh_90_low,
         round(100 * p + 100 * margin, 8) AS wfh_90_high
  FROM (SELECT *, CASE WHEN {radicand} >= 0 THEN sqrt({radicand})
                       ELSE sqrt(moe * moe + p * p * summary_moe * summary_moe) END
                  / nullif(summary_est, 0) AS margin
        FROM (SELECT *, estimate / nullif(summary_est, 0) AS p FROM {source}))"""


def _sectors_wide() -> str:
    names = [
        f"NATION_{(int(a) - views.AREA_BASE) // views.AREA_STEP}" for a in views.COMPARED_AREAS
    ]
    cells = ", ".join(
        f"""round(max(CASE WHEN msa_short_name = '{n}' THEN prop END), 8) AS "{n}\"""" for n in names
    )
    return f"""WITH {PARSED}, {AREAS}, listed AS (
    SELECT area_code, supersector_code,
           100 * value / nullif(CASE WHEN count(value) OVER g = count(*) OVER g
                                     THEN sum(value) OVER g END, 0) AS prop
    FROM averages
    WHERE supersector_code IN ({_texts(fixed.REPORTED_SUPERSECTORS)})
      AND area_code IN ({_texts(views.COMPARED_AREAS)})
    WINDOW g AS (PARTITION BY area_code))
  SELECT supersector_name, {cells}
  FROM listed JOIN area_names ON area_code = GEOID JOIN lookup USING (supersector_code)
  GROUP BY supersector_name"""


_ORDER_LABEL = """'  a "' || o_orderpriority || '",  b\\ '"""

ORACLE: dict[str, str] = {
    # sources and sinks
    "csv_roundtrip": f"""
        SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, {_ORDER_LABEL} AS label,
               CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders""",
    "tsv_trimmed_read": """
        SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_name AS name,
               '"' || c_mktsegment || '"  \\"' AS segment,
               CASE WHEN c_nationkey <> 7 THEN lpad(CAST(c_nationkey AS VARCHAR), 3, '0') END AS nation
        FROM customer""",
    "fixed_width_read": f"WITH {PERSONS} SELECT * FROM persons",
    "attach_denominator": f"""
        SELECT GEOID, NAME, variable, round(estimate, 8) AS estimate, round(moe, 8) AS moe,
               round(summary_est, 8) AS summary_est, round(summary_moe, 8) AS summary_moe
        FROM ({COUNTY})""",
    "catalogue_from_match": """
        SELECT p_partkey, p_brand, p_name FROM part
        WHERE p_partkey >= (SELECT min(p_partkey) FROM part WHERE p_brand = 'Brand#17')""",
    # projections
    "rename_columns": """
        SELECT o_orderkey, o_orderpriority AS "Order Priority", o_totalprice AS "Total Price"
        FROM orders""",
    "select_reorder": "SELECT c_nationkey, c_name, c_custkey FROM customer",
    "derived_columns": """
        SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * l_discount, 4) AS saved,
               round(l_extendedprice - l_extendedprice * l_discount, 4) AS paid FROM lineitem""",
    "apply_to_columns": """
        SELECT l_orderkey, round(l_quantity * 100, 4) AS l_quantity,
               round(l_discount * 100, 4) AS l_discount, round(l_tax * 100, 4) AS l_tax
        FROM lineitem""",
    "number_to_text": f"""WITH {AREAS}
        SELECT GEOID, c_custkey, NAME FROM customer
        JOIN areas ON GEOID = CAST({views.AREA_BASE} + {views.AREA_STEP} * c_nationkey AS VARCHAR)""",
    "recode_ranges": f"WITH {SECTORED} SELECT IND, supersector_code, supersector_name FROM sectored",
    "recode_long_table": f"""WITH {PERSONS}
        SELECT IND, WTFINL, CASE WHEN IND % 25 <= 19 THEN 'band ' || CAST(IND // 25 AS VARCHAR) END
               AS band FROM persons""",
    "split_delimited": """
        SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS priority_code,
               split_part(o_orderpriority, '-', 2) AS priority_name FROM orders""",
    "parse_fixed_width_code": f"WITH {SERIES} SELECT series_id, period, year, {_SLICES} FROM series",
    "safe_numeric_cast": """
        SELECT l_orderkey, l_linenumber,
               CASE WHEN l_returnflag <> 'R' AND l_linestatus <> 'O' THEN l_quantity END AS value
        FROM lineitem""",
    # filters
    "filter_universe": f"""WITH {PERSONS}
        SELECT * FROM persons WHERE IND >= 100 AND TELWRKPAY IN (1, 2)""",
    "filter_in_list": f"""WITH {PERSONS}
        SELECT * FROM persons WHERE METFIPS IN ({_numbers(views.LISTED_AREAS)})""",
    "filter_in_long_list": f"WITH {PERSONS} SELECT * FROM persons WHERE IND % 7 = 0",
    "filter_date_range": f"""
        SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem
        WHERE CAST(l_shipdate AS DATE)
              BETWEEN DATE '{views.COMPARED_WEEKS[0]}' AND DATE '{views.COMPARED_WEEKS[1]}'""",
    "filter_not_missing": f"""WITH {PERSONS}
        SELECT YEAR, MONTH, METFIPS, IND, round({SHARE}, 8) AS rate FROM persons
        WHERE TELWRKPAY <> 0 GROUP BY ALL HAVING sum(WTFINL) <> 0""",
    "filter_conjunction": f"WITH {PARSED} SELECT * FROM averages",
    "filter_after_aggregate": f"""WITH {SECTORED}
        SELECT supersector_code, round({SHARE}, 8) AS rate FROM sectored
        WHERE TELWRKPAY <> 0 AND supersector_code <> '00' GROUP BY 1""",
    "filter_after_window": f"""WITH {SUPPLIER_PANEL},
        {_dense_mean('l_suppkey', 2, '(SELECT DISTINCT data_week FROM panel)', 'mean2')}
        SELECT data_week, l_suppkey, round(occupancy, 8) AS occupancy, round(mean2, 8) AS mean2
        FROM rolled WHERE occupancy IS NOT NULL AND data_week >= DATE '{views.FIRST_WEEK}'""",
    # joins
    "join_lookup": """
        SELECT c_nationkey, c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "join_dimension": """
        SELECT l_orderkey, l_suppkey, l_quantity, s_name FROM lineitem
        JOIN supplier ON l_suppkey = s_suppkey""",
    "join_null_safe": f"""WITH {SECTORED}
        SELECT f.supersector_code, f.supersector_name, round(f.rate, 8) AS focus_rate,
               round(t.rate, 8) AS total_rate
        FROM (SELECT supersector_code, supersector_name, {SHARE} AS rate FROM sectored
              WHERE TELWRKPAY <> 0 AND METFIPS = {views.FOCUS_AREA} GROUP BY 1, 2) f
        JOIN (SELECT supersector_code, supersector_name, {SHARE} AS rate FROM sectored
              WHERE TELWRKPAY <> 0 GROUP BY 1, 2) t
        ON f.supersector_code IS NOT DISTINCT FROM t.supersector_code
           AND f.supersector_name IS NOT DISTINCT FROM t.supersector_name""",
    # aggregates
    "weighted_share_by_group": f"""WITH {PERSONS}
        SELECT IND, METFIPS, round({SHARE}, 8) AS rate FROM persons
        WHERE TELWRKPAY <> 0 GROUP BY IND, METFIPS""",
    "weighted_share_global": f"""WITH {PERSONS}
        SELECT '{views.TOTAL_ID}' AS METFIPS, round({SHARE}, 8) AS rate FROM persons
        WHERE TELWRKPAY <> 0""",
    "mean_by_group": """
        SELECT l_partkey, round(CASE WHEN count(quantity) = count(*) THEN avg(quantity) END, 8)
               AS mean_quantity
        FROM (SELECT l_partkey, CASE WHEN l_quantity < 49 THEN l_quantity END AS quantity
              FROM lineitem) GROUP BY l_partkey""",
    "metro_and_total": f"""WITH {PERSONS}
        SELECT YEAR, MONTH, METFIPS, round(wfh_pct, 8) AS rate FROM ({_monthly('persons')})
        WHERE wfh_pct IS NOT NULL""",
    "grouped_with_missing_key": f"""WITH {SECTORED}
        SELECT supersector_code, YEAR, round({SHARE}, 8) AS rate FROM sectored
        WHERE TELWRKPAY <> 0 GROUP BY supersector_code, YEAR""",
    "telework_cube": f"""WITH {SECTORED}
        SELECT YEAR, MONTH, METFIPS, supersector_code, sum(WTFINL) AS sum_w,
               sum(CASE WHEN TELWRKPAY = 1 THEN WTFINL ELSE 0 END) AS sum_w_yes,
               CAST(0 AS BIGINT) AS n_missing
        FROM sectored WHERE TELWRKPAY <> 0 GROUP BY YEAR, MONTH, METFIPS, supersector_code""",
    # windows and rows
    "rolling_mean_trailing": f"""WITH {SUPPLIER_PANEL},
        {_dense_mean('l_suppkey', 4, '(SELECT DISTINCT data_week FROM panel)', 'mean4')}
        SELECT data_week, l_suppkey, round(occupancy, 8) AS occupancy, round(mean4, 8) AS mean4
        FROM rolled WHERE occupancy IS NOT NULL""",
    "share_of_total": """
        SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity,
               round(100 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey), 8) AS share_pct
        FROM lineitem""",
    "order_series_by_latest": f"""WITH {SUPPLIER_PANEL}
        SELECT s.l_suppkey, round(p.occupancy, 8) AS latest
        FROM (SELECT DISTINCT l_suppkey FROM lineitem) s
        LEFT JOIN panel p ON p.l_suppkey = s.l_suppkey
             AND p.data_week = (SELECT max(data_week) FROM panel)""",
    "row_mean_across_series": f"""WITH {CITY_PANEL}, {_dense_mean('city', 4, 'weeks', 'mean4')}
        SELECT data_week, round(CASE WHEN count(mean4) = (SELECT count(DISTINCT city) FROM panel)
                                     THEN avg(mean4) END, 8)
               AS mean_of_cities FROM rolled GROUP BY data_week""",
    # reshaping and order
    "pivot_wide": "SELECT l_suppkey, {week} AS data_week, {cells} FROM lineitem GROUP BY 1, 2".format(
        week=WEEK,
        cells=", ".join(
            f"sum(CASE WHEN l_returnflag || l_linestatus = '{k}' THEN l_quantity END) AS \"{k}\""
            for k in ["NO", "NF", "AO", "AF", "RO", "RF"]
        ),
    ),
    "pivot_ordered": """SELECT o_custkey, {cells},
        (SELECT string_agg(substring(p, 3), '|' ORDER BY p)
         FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)) AS column_order
        FROM orders GROUP BY 1""".format(
        cells=", ".join(
            f"nullif(count(CASE WHEN o_orderpriority LIKE '%-{k}' THEN 1 END), 0) AS \"{k}\""
            for k in ["URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"]
        ),
    ),
    "union_by_name": """
        SELECT c_nationkey AS nation, c_name AS name, c_mktsegment FROM customer
        UNION ALL SELECT s_nationkey, s_name, NULL FROM supplier""",
    "sort_desc_nulls_last": """
        SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price
        FROM orders ORDER BY price DESC NULLS LAST, o_orderkey""",
    # scalar functions
    "short_place_name": r"""
        SELECT p_partkey, place, regexp_replace(regexp_replace(place, '-.*$', ''), ',.*$', '') AS short_name
        FROM (SELECT p_partkey, CASE WHEN p_size <= 20 THEN p_brand || '-' || p_type || ', ' || p_name
                     WHEN p_size <= 40 THEN p_name || ', A-B' ELSE p_name END AS place FROM part)""",
    "year_month_to_date": f"""WITH {PERSONS}
        SELECT YEAR, MONTH, METFIPS, make_date(YEAR, MONTH, 1) AS date FROM persons""",
    "period_to_date": f"WITH {PARSED} SELECT series_id, year, period, date FROM parsed",
    "ratio_pct": """
        SELECT l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0) * 100, 8) AS pct
        FROM lineitem""",
    "moe_of_proportion": """
        SELECT l_orderkey, l_linenumber,
               round(100 * sqrt(CASE WHEN own >= carried THEN own - carried ELSE own + carried END)
                     / l_extendedprice, 8) AS moe_pct
        FROM (SELECT *, CASE WHEN l_returnflag <> 'N'
                             THEN l_quantity * l_discount * l_quantity * l_discount END AS own,
                     l_quantity * l_quantity * (l_tax + 0.005) * (l_tax + 0.005) AS carried FROM lineitem)""",
    # whole statistics
    "occupancy_weekly_wide": _weekly_wide(),
    "occupancy_columns_by_latest": _columns_by_latest(),
    "estimates_stacked": f"""WITH {ESTIMATES}
        SELECT GEOID, NAME, variable, round(estimate, 8) AS estimate, round(moe, 8) AS moe,
               round(summary_est, 8) AS summary_est, round(summary_moe, 8) AS summary_moe
        FROM estimates""",
    "wfh_share_with_bounds": f"""WITH {ESTIMATES} {_bounds('estimates')}
        WHERE GEOID IN ({_texts([*views.LISTED_AREAS, '15460', views.TOTAL_ID])})""",
    "telework_monthly_long": f"""WITH {PERSONS}
        SELECT YEAR, MONTH, METFIPS, round(wfh_pct, 8) AS wfh_pct FROM ({_monthly('persons')})
        WHERE wfh_pct IS NOT NULL""",
    "telework_monthly_wide": _monthly_wide(PERSONS, _monthly("persons")),
    "telework_by_sector": f"""WITH {SECTORED}
        SELECT f.supersector_code, f.supersector_name, round(100 * f.rate, 8) AS focus_wfh_pct,
               round(100 * t.rate, 8) AS total_wfh_pct
        FROM (SELECT supersector_code, supersector_name, {SHARE} AS rate FROM sectored
              WHERE TELWRKPAY <> 0 AND METFIPS = {views.FOCUS_AREA} GROUP BY 1, 2) f
        JOIN (SELECT supersector_code, {SHARE} AS rate FROM sectored
              WHERE TELWRKPAY <> 0 GROUP BY 1) t USING (supersector_code)
        WHERE supersector_code <> '00'""",
    "office_telework_by_area": f"""WITH {SECTORED}, {AREAS}
        SELECT METFIPS, round(wfh_pct, 8) AS wfh_pct, NAME, msa_short_name FROM ({_area_rates()})""",
    "office_telework_monthly_long": f"""WITH {SECTORED}
        SELECT YEAR, MONTH, METFIPS, round(wfh_pct, 8) AS wfh_pct
        FROM ({_monthly('sectored', _OFFICE)}) WHERE wfh_pct IS NOT NULL""",
    "office_telework_monthly_wide": _monthly_wide(SECTORED, _monthly("sectored", _OFFICE)),
    "employment_series_parsed": f"WITH {PARSED} SELECT * FROM parsed",
    "employment_sector_share_wide": _sectors_wide(),
    "occupancy_and_telework": f"""WITH {SECTORED}, {CITY_PANEL}
        SELECT city, round(mean, 8) AS "{fixed.OCCUPANCY_NAME}", METFIPS,
               round(wfh_pct, 8) AS "{fixed.TELEWORK_NAME}", NAME
        FROM (SELECT city, avg(occupancy) AS mean FROM panel
              WHERE data_week BETWEEN DATE '{views.COMPARED_WEEKS[0]}'
                AND DATE '{views.COMPARED_WEEKS[1]}' GROUP BY city)
        JOIN ({_area_rates()}) ON city = msa_short_name""",
    "wfh_share_by_county": f"""
        SELECT GEOID, NAME, regexp_replace(regexp_replace(NAME, '-.*$', ''), ',.*$', '') AS msa_short_name,
               round(estimate / nullif(summary_est, 0) * 100, 8) AS wfh_prop
        FROM ({COUNTY}) WHERE GEOID IN ({_texts(views.LISTED_SUPPLIERS)})""",
}
