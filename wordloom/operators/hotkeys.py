"""Per-key results with even work, however many rows one key holds.

Exact offset chunking: keys are counted per input partition, the counts are
prefix-summed into offsets, every row gets its number in key order, and rows are
worked on in equal-sized chunks of these numbers; the states of keys that cross a
border of a chunk or of an input partition are merged in order.  The input is read
twice, and rows move once, by key within their input partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.prefixsum import prefix_sum
from wordloom.session import shuffle_partitions
from wordloom.storage import materialize

#: Counts of (input partition, key) that one window sums into offsets, about; rows of a chunk at most.
OFFSET_ROWS, CHUNK_ROWS = 1 << 16, 1 << 20


def _placed(df: DataFrame, key: str) -> DataFrame:
    """Rows with a key, and where they lie in the input: ``_part`` and ``_pos``."""
    rows = df.where(F.col(key).isNotNull()).withColumn("_pos", F.monotonically_increasing_id())
    return rows.withColumn("_part", F.shiftright("_pos", 33).cast("int"))


def partition_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per input partition and key, written once: _part, key, _n."""
    return materialize(_placed(df, key).groupBy("_part", key).agg(F.count(F.lit(1)).alias("_n")), "key-counts")


def number_rows(df: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """Add ``row_no``, the row's number when all rows lie sorted by key, and ``_part``.

    ``df`` keeps its columns; rows with a null key are left out.  The order of keys is
    (hash bucket, key), that of a key's rows is the order in which the input is read:
    files as the scan orders them, rows of a file as they are stored.  A key's rows are
    numbered apart in each input partition, so no task gets more of a hot key than one
    input partition held.
    """
    counts = partition_counts(df, key) if counts is None else counts
    buckets = max(1, -(-counts.count() // OFFSET_ROWS))
    keys = ["_part", key]
    w = Window.partitionBy(*keys).orderBy("_pos")
    numbered = _placed(df, key).withColumn("_local", F.row_number().over(w))
    counts = counts.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    offsets = prefix_sum(counts, "_bucket", [key, "_part"], "_n", "_offset").select(*keys, "_offset")
    return numbered.join(offsets, keys).withColumn("row_no", F.col("_offset") + F.col("_local") - 1).drop("_local", "_offset", "_pos")


def fold_by_key(df: DataFrame, key: str, value: str | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Per key: ``n_rows`` and, with ``value``, sum, extremes, first, last and changes.

    ``changes`` counts neighbouring rows of a key, in the order of :func:`number_rows`,
    whose values differ (null equals null); ``first``/``last`` are the values at its
    ends, null where that row holds null.  Chunks hold ``chunk_rows`` rows (default: a
    quarter of an even share per shuffle partition, ``CHUNK_ROWS`` at most), whatever
    the keys are.
    """
    cols = [key] if value is None else [key, value]
    counts = partition_counts(df.select(*cols), key)
    if chunk_rows is None:
        total = counts.agg(F.sum("_n")).first()[0] or 0
        chunk_rows = min(CHUNK_ROWS, max(1, -(-total // (4 * shuffle_partitions(df.sparkSession)))))
    chunked = number_rows(df.select(*cols), key, counts).withColumn("chunk", F.floor(F.col("row_no") / chunk_rows))
    if value is None:
        # Counted per chunk where the rows were numbered; only the counts move on.
        states = chunked.groupBy("chunk", key).agg(F.count(F.lit(1)).alias("n_rows"))
        return states.groupBy(key).agg(F.sum("n_rows").alias("n_rows"))

    own = ["_part", key]
    inside = Window.partitionBy(*own).orderBy("row_no")
    v, again = F.col(value), F.lag("chunk").over(inside).eqNullSafe(F.col("chunk"))
    states = (
        chunked.withColumn("_changed", again & ~v.eqNullSafe(F.lag(v).over(inside)))
        .groupBy(*own, "chunk")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.min("row_no").alias("at"),
            F.min_by(v, "row_no").alias("a"), F.max_by(v, "row_no").alias("z"), F.sum(F.col("_changed").cast("bigint")).alias("c"),
        )
    )
    # A key has one state per chunk and input partition it lies in.
    across = Window.partitionBy(key).orderBy("at")
    joint = ((F.row_number().over(across) > 1) & ~F.col("a").eqNullSafe(F.lag("z").over(across))).cast("bigint")
    return (
        states.withColumn("joint", joint)
        .groupBy(key)
        .agg(
            F.sum("n").alias("n_rows"), F.sum("s").alias("sum_value"), F.min("lo").alias("min_value"), F.max("hi").alias("max_value"),
            F.min_by("a", "at").alias("first_value"), F.max_by("z", "at").alias("last_value"),
            (F.sum("c") + F.sum("joint")).alias("changes"),
        )
    )


def hot_keys(df: DataFrame, key: str, one_in: int) -> DataFrame:
    """Keys that hold more than one in ``one_in`` of all stored rows (null keys count only in the total)."""
    total = df.select(key).count()
    return fold_by_key(df, key).where(F.col("n_rows") * one_in > F.lit(total))
