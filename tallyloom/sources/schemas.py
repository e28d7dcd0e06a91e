"""Declared schemas of the staged tables. Nothing is inferred: inference reads a file twice
and turns codes such as ``06`` into numbers."""

# One row per week and city; percent of normal office attendance.
OCCUPANCY = "data_week DATE, city STRING, occupancy DOUBLE"

# One row per geography and variable, the denominator beside it.
ESTIMATES = (
    "GEOID STRING, NAME STRING, variable STRING, "
    "estimate DOUBLE, moe DOUBLE, summary_est DOUBLE, summary_moe DOUBLE"
)

# The same as pulled: a row for the numerator and one for the denominator.
PULL = "GEOID STRING, NAME STRING, variable STRING, estimate DOUBLE, moe DOUBLE"

# One row per person and month.
PERSONS = "YEAR INT, MONTH INT, METFIPS INT, IND INT, TELWRKPAY INT, WTFINL DOUBLE"

# Long monthly rates; the rate is a fraction.
MONTHLY_RATES = "YEAR INT, MONTH INT, METFIPS STRING, wfh_pct DOUBLE"

# One row per series and period, as published: text throughout, padded with spaces.
SERIES = "series_id STRING, year STRING, period STRING, value STRING, footnote_codes STRING"

# The same after parsing the identifier.
PARSED_SERIES = (
    "series_id STRING, year STRING, period STRING, value DOUBLE, footnote_codes STRING, "
    "seas_adj STRING, state_code STRING, area_code STRING, supersector_code STRING, "
    "naics_code STRING, industry_code STRING, measure_code STRING, date DATE"
)

SUPERSECTORS = "supersector_code STRING, supersector_name STRING"
