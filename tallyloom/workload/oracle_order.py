"""SQL twins of the queries that hold their order: a row number over the plain twin."""

from __future__ import annotations

from .oracle import ORACLE
from .views import TOTAL_ID


def _numbered(name: str, order: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS position FROM ({ORACLE[name]})"


ORACLE |= {
    "positions_by_price": _numbered("sort_desc_nulls_last", "price DESC NULLS LAST, o_orderkey"),
    "positions_missing_key_last": _numbered(
        "grouped_with_missing_key", "supersector_code NULLS LAST, YEAR"
    ),
    "positions_wfh_share": _numbered("wfh_share_with_bounds", "wfh_prop DESC NULLS LAST, GEOID"),
    "positions_wfh_share_by_county": _numbered(
        "wfh_share_by_county", "wfh_prop DESC NULLS LAST, GEOID"
    ),
    "positions_telework_monthly": _numbered(
        "telework_monthly_long", f"METFIPS = '{TOTAL_ID}', YEAR, MONTH, METFIPS"
    ),
    "positions_telework_by_sector": _numbered(
        "telework_by_sector", "total_wfh_pct DESC NULLS LAST, supersector_code"
    ),
    "positions_office_telework_by_area": _numbered(
        "office_telework_by_area", "wfh_pct DESC NULLS LAST, METFIPS"
    ),
}
