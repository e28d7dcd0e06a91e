"""Column expressions. All are built-in Spark functions; none needs a Python worker."""

from .dates import period_to_date, week_start, year_month_to_date
from .numbers import moe_of_proportion, plain_number, ratio, ratio_pct, safe_double
from .text import blank_to_null, code_slices, short_place_name, split_labels

__all__ = [
    "blank_to_null",
    "code_slices",
    "moe_of_proportion",
    "period_to_date",
    "plain_number",
    "ratio",
    "ratio_pct",
    "safe_double",
    "short_place_name",
    "split_labels",
    "week_start",
    "year_month_to_date",
]
