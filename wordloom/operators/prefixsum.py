"""Prefix sums over any number of rows without one task that sees them all.

Rows fall into buckets; a bucket's start is the sum of the buckets before it (a
table of at most ``n_buckets`` rows), and inside a bucket a window adds up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_starts(df: DataFrame, bucket: str, value: Column, within: Sequence[str] = ()) -> DataFrame:
    """Per ``within`` group and bucket, the sum of ``value`` over all earlier buckets.

    Columns: ``within``, ``bucket``, ``bucket_start``.  Rows: at most groups x buckets.
    """
    keys = [*within, bucket]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    w = Window.partitionBy(*(within or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, F.coalesce(F.sum("_total").over(w), F.lit(0)).cast("bigint").alias("bucket_start"))


def prefix_sum(df: DataFrame, bucket: str, order: Sequence[str], value: str, out: str, within: Sequence[str] = ()) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one.

    The order is bucket, then ``order`` (which must be total inside a bucket).
    ``within`` restarts the sum per group; a group of any size is still cut into
    its buckets.  The start table is joined back on the bucket; it holds one row
    per group and bucket, so it is small by construction.
    """
    keys = [*within, bucket]
    starts = bucket_starts(df, bucket, F.col(value), within)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_inner", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return (
        inner.join(F.broadcast(starts), keys, "left")
        .withColumn(out, (F.col("_inner") + F.col("bucket_start")).cast("bigint"))
        .drop("_inner", "bucket_start")
    )
