"""SQL twins of the queries over written files: the same results straight from the tables."""

from __future__ import annotations

from .oracle import ORACLE, SECTORED
from .queries_files import WANTED

_CATALOGUE = """catalogue AS (
  SELECT p_partkey, p_brand,
         CASE WHEN p_partkey % 3 = 0 THEN p_name || chr(10) || '"' || p_type || '",' ELSE p_name END AS p_name
  FROM part)"""

ORACLE |= {
    "quoted_csv_read": f"""WITH {_CATALOGUE}
        SELECT p_brand, p_name, row_number() OVER (ORDER BY p_partkey) AS entry FROM catalogue""",
    "catalogue_without_ordinal": f"""WITH {_CATALOGUE}
        SELECT p_brand, p_name, row_number() OVER (ORDER BY p_partkey) AS entry FROM catalogue
        WHERE p_partkey >= (SELECT min(p_partkey) FROM part WHERE p_brand = '{WANTED}')""",
    "telework_cube_refreshed": ORACLE["telework_cube"],
    "pivot_in_blocks": """
        WITH days AS (
          SELECT l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, l_quantity FROM lineitem),
        named AS (
          SELECT day, row_number() OVER (ORDER BY day) - 1 AS column_number
          FROM (SELECT DISTINCT day FROM days))
        SELECT l_suppkey, day, sum(l_quantity) AS quantity, column_number
        FROM days JOIN named USING (day) GROUP BY l_suppkey, day, column_number""",
    "join_null_safe_hot": f"""WITH {SECTORED},
        cut AS (
          SELECT CASE WHEN IND % 3 <> 0 THEN supersector_code END AS sector,
                 CASE WHEN IND % 3 <> 0 THEN METFIPS END AS area, YEAR, WTFINL FROM sectored),
        weights AS (SELECT sector, area, YEAR, sum(WTFINL) AS weight FROM cut GROUP BY ALL)
        SELECT c.sector, c.area, count(*) AS pairs, sum(c.WTFINL * w.weight) AS product
        FROM cut c JOIN weights w ON c.sector IS NOT DISTINCT FROM w.sector
             AND c.area IS NOT DISTINCT FROM w.area GROUP BY c.sector, c.area""",
}
