"""DataFrame to DataFrame operators."""

from .checks import duplicate_keys, wrong_piece_count
from .exact import (
    exact_mean_by_group,
    exact_row_mean_across_series,
    exact_share_rates,
    exact_sum_columns,
    exact_sum_of,
    exact_sums,
    value_grid,
)
from .filters import keep_dates, keep_listed
from .hot_join import frequent_keys, join_null_safe_hot
from .joins import attach_denominator, join_dimension, join_lookup, join_null_safe
from .long_windows import exact_rolling_mean, trailing_mean
from .panel import (
    latest_values,
    rolling_mean,
    row_mean,
    row_mean_across_series,
    share_of_total,
    time_axis,
)
from .positions import block_carries, number_rows, present_blocks, sorted_blocks, with_positions
from .range_lookup import dyadic_intervals, lookup_ranges
from .recode import label_codes, recode_ranges
from .reshape import ordered_values, pivot_ordered, sort_desc_nulls_last, union_by_name
from .shares import (
    mean_by_group,
    rate,
    rates_with_total,
    row_tallies,
    share_rates,
    tally,
    total_rate,
)
from .wide_blocks import blocks_to_long, pivot_blocks, read_wide

__all__ = [
    "attach_denominator",
    "block_carries",
    "blocks_to_long",
    "duplicate_keys",
    "dyadic_intervals",
    "exact_mean_by_group",
    "exact_rolling_mean",
    "exact_row_mean_across_series",
    "exact_share_rates",
    "exact_sum_columns",
    "exact_sum_of",
    "exact_sums",
    "frequent_keys",
    "join_dimension",
    "join_lookup",
    "join_null_safe",
    "join_null_safe_hot",
    "keep_dates",
    "keep_listed",
    "label_codes",
    "latest_values",
    "lookup_ranges",
    "mean_by_group",
    "number_rows",
    "ordered_values",
    "pivot_blocks",
    "pivot_ordered",
    "present_blocks",
    "rate",
    "rates_with_total",
    "read_wide",
    "recode_ranges",
    "rolling_mean",
    "row_mean",
    "row_mean_across_series",
    "row_tallies",
    "share_of_total",
    "share_rates",
    "sort_desc_nulls_last",
    "sorted_blocks",
    "tally",
    "time_axis",
    "total_rate",
    "trailing_mean",
    "union_by_name",
    "value_grid",
    "with_positions",
    "wrong_piece_count",
]
