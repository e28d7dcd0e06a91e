"""Neighbours in the order of doc_id, without bringing all rows into one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows that one range of the order should hold.
RANGE_ROWS = 4_096
# Bounds that the driver keeps; beyond these, ranges hold more rows.
MAX_RANGES = 100_000


def ranged(docs: DataFrame, n_rows: int) -> DataFrame:
    """Adds ``range``: rows of a higher range have smaller doc_ids, rows without one the highest.

    Bounds are approximate quantiles of doc_id over all rows, so ranges are about equal in rows.
    """
    n_ranges = min(MAX_RANGES, max(1, -(-n_rows // RANGE_ROWS)))
    shares = [i / n_ranges for i in range(1, n_ranges)]
    bounds = np.zeros(0, np.int64)
    if shares:
        found = docs.agg(F.percentile_approx("doc_id", shares, 20 * n_ranges).alias("at")).first()["at"]
        bounds = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def place(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna().to_numpy()
        out = np.full(len(doc_id), len(bounds) + 1, np.int32)
        ids = doc_id[known].astype("int64").to_numpy()
        out[known] = len(bounds) - np.searchsorted(bounds, ids, side="left")
        return pd.Series(out)

    return docs.withColumn("range", place("doc_id"))
