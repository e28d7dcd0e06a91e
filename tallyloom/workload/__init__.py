"""Registered queries over the test tables, and their SQL twins."""

from . import (  # noqa: F401  (they register)
    oracle_exact,
    oracle_files,
    oracle_order,
    queries_exact,
    queries_files,
    queries_order,
)
