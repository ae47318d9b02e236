"""Pruning the stored model: levels, dead bands, referential integrity, dense ids."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.corpus import ordered_scan

NGRAM_BAND, BAYES_BAND, DELETED_LEVEL = (0.5, 2.0), (0.04, 25.0), 4


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` columns (nulls lowest)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def outside_band(factor: Column, band: tuple[float, float]) -> Column:
    """Whether a factor says something: not null or NaN, and outside the band (its ends are inside)."""
    return factor.isNotNull() & ~F.isnan(factor) & ((factor < band[0]) | (factor > band[1]))


def prefix_levels(prefixes: DataFrame, depth: int = DELETED_LEVEL) -> DataFrame:
    """id and level (1 for roots) of prefixes down to ``depth``, one join per level."""
    links = prefixes.select("id", "parent").where("id is not null").distinct()
    level = links.where("parent = -1").select("id", F.lit(1).cast("bigint").alias("level"))
    found = level
    for k in range(2, depth + 1):
        above = level.select(F.col("id").alias("parent")).distinct()
        level = links.join(above, "parent", "left_semi").select("id", F.lit(k).cast("bigint").alias("level"))
        found = found.unionByName(level)
    return found.groupBy("id").agg(F.min("level").alias("level"))


def cleanup(words: DataFrame, bayes: DataFrame, prefixes: DataFrame, ngrams: DataFrame, fixpoint: int = 1, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> dict[str, DataFrame]:
    """The pruned tables, by name; deletions in the fixed order in which they are observable.

    Prefixes of the deleted level go, then factors inside their dead bands, then pairs
    with an unknown word, prefixes with an unknown word, without an n-gram or with a
    missing parent (``fixpoint`` passes; one pass leaves grandchildren), n-grams
    without prefix or follower, and words to which nothing refers.  ``keep`` gets every
    table that is read more than once, with a name, and may write it.
    """
    semi = lambda df, col, other, key: df.join(other.select(F.col(key).alias(col)).distinct(), col, "left_semi").select(*df.columns)
    deep = prefix_levels(prefixes).where(F.col("level") == DELETED_LEVEL)
    prefixes = prefixes.join(deep.select("id"), "id", "left_anti").select(*prefixes.columns)
    ngrams = keep(ngrams.where(outside_band(F.col("factor"), NGRAM_BAND)), "banded-ngrams")
    bayes = bayes.where(outside_band(F.col("factor"), BAYES_BAND))
    bayes = keep(semi(semi(bayes, "condition", words, "id"), "conditional", words, "id").drop("occurences"), "pruned-bayes")
    prefixes = keep(semi(semi(prefixes, "word", words, "id"), "id", ngrams, "prefix"), "used-prefixes")
    for _ in range(fixpoint):
        inner = semi(prefixes.where("parent <> -1"), "parent", prefixes, "id")
        prefixes = prefixes.where("parent = -1").unionByName(inner)
    prefixes = keep(prefixes, "pruned-prefixes")
    ngrams = keep(semi(semi(ngrams, "prefix", prefixes, "id"), "follower", words, "id"), "pruned-ngrams")
    used = None
    for frame, column in ((bayes, "condition"), (bayes, "conditional"), (prefixes, "word"), (ngrams, "follower")):
        ids = frame.select(F.col(column).alias("id"))
        used = ids if used is None else used.unionByName(ids)
    words = keep(semi(words, "id", used, "id"), "pruned-words")
    return {"words": words, "bayes": bayes, "prefixes": prefixes, "ngrams": ngrams}


def model_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table: name, n."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def dense_ids(df: DataFrame, id: str = "id") -> DataFrame:
    """Old id and new_id 1..n in the order of the old ones; repeated and null ids count once or not."""
    ids = df.select(F.col(id).alias("old_id")).where("old_id is not null").distinct()
    return ordered_scan(ids, [F.col("old_id")]).select("old_id", (F.col("row_no") + 1).alias("new_id"))


def remap(df: DataFrame, columns: Mapping[str, DataFrame], keep_missing: Mapping[str, int] | None = None) -> DataFrame:
    """Replace id columns by their new ids; a row whose id has no new one goes, except for values in ``keep_missing``."""
    order = df.columns
    for column, ids in columns.items():
        special = (keep_missing or {}).get(column)
        how = "inner" if special is None else "left"
        df = df.join(ids.select(F.col("old_id").alias(column), F.col("new_id").alias("_new")), column, how)
        if special is not None:
            df = df.withColumn("_new", F.when(F.col(column) == special, F.lit(special)).otherwise(F.col("_new"))).where("_new is not null")
        df = df.drop(column).withColumnRenamed("_new", column)
    return df.select(*order)
