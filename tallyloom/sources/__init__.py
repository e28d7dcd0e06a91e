"""Readers of staged files and the writer of report tables."""

from . import schemas
from .catalogue import catalogue_from_match
from .delimited import read_typed_csv, read_trimmed_tsv, write_report
from .fixed_width import read_fixed_width
from .lines import read_lines, read_quoted_csv, read_quoted_records

__all__ = [
    "catalogue_from_match",
    "read_fixed_width",
    "read_lines",
    "read_quoted_csv",
    "read_quoted_records",
    "read_trimmed_tsv",
    "read_typed_csv",
    "schemas",
    "write_report",
]
