"""Restricted Damerau-Levenshtein distance of word lists, by Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def osa(a, b, delete: int = 1, insert: int = 1, substitute: int = 1, swap: int = 1) -> int:
    """Cost of turning list ``a`` into ``b``; neighbours may be swapped once."""
    rows = [[insert * j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [delete * i]
        for j, y in enumerate(b, 1):
            cost = min(rows[-1][j] + delete, row[-1] + insert, rows[-1][j - 1] + (0 if x == y else substitute))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[-2][j - 2] + swap)
            row.append(cost)
        rows.append(row)
    return rows[-1][-1]


def list_distance(a: Column, b: Column, **costs: int) -> Column:
    """:func:`osa` of two array columns as bigint; a null list counts as empty."""

    @F.pandas_udf("bigint")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([osa([] if p is None else list(p), [] if q is None else list(q), **costs) for p, q in zip(x, y, strict=True)], dtype="int64")

    return run(a, b)
