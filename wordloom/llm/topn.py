"""The best N items of every group, with one fixed order among equals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Rows ranked 1..n inside each group by ``order``.

    The rank filter over row_number lets the optimizer put a group limit before the
    shuffle and another after it, so a group of any size sends at most ``n`` rows per
    task.  ``order`` should end in an identifier; rows equal in all of it are
    interchangeable.  Null groups form one group.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def latest(df: DataFrame, keys: Sequence[str], at: Sequence[str]) -> DataFrame:
    """Of each key the row with the greatest ``at`` columns (nulls lowest)."""
    return top_n(df, keys, [F.col(c).desc_nulls_last() for c in at], 1, "_latest").drop("_latest")
