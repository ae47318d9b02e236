"""Words of one sentence: co-occurrence counts and Bayes factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a sentence that are paired in one row; longer ones are cut into pairs of blocks.
BLOCK = 256


def distinct_words(words: Column) -> Column:
    """The distinct words of a sentence in order; null words are ignored, a null array is empty."""
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(words, lambda x: x.isNotNull()))), F.array().cast("array<bigint>"))


def emit_pairs(rows: DataFrame, keep: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(word_a, word_b) for each two positions of ``words``, the earlier first; columns ``keep`` stay.

    A sentence of any length is handled: pairs of blocks become rows of their own, so
    no row holds more than two blocks and no array of pairs is ever built.
    """
    n_blocks = F.ceil(F.size("words") / block).cast("int")
    grid = rows.where(F.size("words") > 1).withColumn("p", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    grid = grid.withColumn("q", F.explode(F.sequence(F.col("p"), n_blocks - 1)))
    cut = lambda k: F.slice("words", F.col(k) * block + 1, block)
    blocks = grid.select(*keep, (F.col("p") == F.col("q")).alias("own"), cut("p").alias("left"), cut("q").alias("right"))
    firsts = blocks.select(*keep, "own", "right", F.posexplode("left").alias("i", "word_a"))
    rest = F.when(F.col("own"), F.slice("right", F.col("i") + 2, block)).otherwise(F.col("right"))
    return firsts.select(*keep, "word_a", F.explode(rest).alias("word_b"))


def pair_counts(sentences: DataFrame, min_count: int = 2, words: str = "words") -> DataFrame:
    """Sentences that hold both words: condition, conditional, occurences; each pair both ways.

    Counted once per unordered pair and mirrored after the rare ones are gone.
    """
    sets = sentences.select(distinct_words(F.col(words)).alias("words"))
    n = emit_pairs(sets).groupBy("word_a", "word_b").agg(F.count(F.lit(1)).alias("occurences")).where(F.col("occurences") >= min_count)
    both = F.explode(F.array(F.struct(F.col("word_a").alias("condition"), F.col("word_b").alias("conditional")), F.struct(F.col("word_b").alias("condition"), F.col("word_a").alias("conditional"))))
    return n.select(both.alias("p"), "occurences").select("p.*", "occurences")


def pair_counts_multiset(sentences: DataFrame, words: str = "words") -> DataFrame:
    """Every two positions count: both ways for different words, once for a word with itself."""
    known = sentences.select(F.filter(F.col(words), lambda x: x.isNotNull()).alias("words"))
    pair = F.struct(F.least("word_a", "word_b").alias("a"), F.greatest("word_a", "word_b").alias("b"))
    n = emit_pairs(known).groupBy(pair.alias("p")).agg(F.count(F.lit(1)).alias("occurences")).select("p.*", "occurences")
    one = F.struct(F.col("a").alias("condition"), F.col("b").alias("conditional"))
    other = F.struct(F.col("b").alias("condition"), F.col("a").alias("conditional"))
    return n.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, other))).alias("p"), "occurences").select("p.*", "occurences")


def odds_factor(total: float, outcome: Column, condition: Column, joint: Column) -> Column:
    """By what the odds of an outcome change under a condition; null where the condition decides it."""
    zero = F.lit(0)
    return (F.lit(total) / F.nullif(outcome, zero) - 1) / F.nullif(condition / F.nullif(joint, zero) - 1, F.lit(0.0))


def bayes_factors(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Add ``factor`` to pairs, from the words' occurrences (``words``: id, occurences)."""
    total = float(words.agg(F.sum("occurences")).first()[0] or 0)
    c = words.select(F.col("id").alias("condition"), F.col("occurences").alias("occ_condition"))
    e = words.select(F.col("id").alias("conditional"), F.col("occurences").alias("occ_conditional"))
    joined = pairs.join(c, "condition", "left").join(e, "conditional", "left")
    factor = odds_factor(total, F.col("occ_conditional"), F.col("occ_condition"), F.col("occurences"))
    return joined.select("condition", "conditional", "occurences", factor.alias("factor"))


def row_sum_factors(pairs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The earlier factor from row sums: (n / c_i) / ((c_j - n) / (total - c_i)); null on division by zero.

    The sums are those of all pairs; with ``wanted`` (condition, conditional) only its pairs are returned.
    """
    sums = pairs.groupBy("condition").agg(F.sum("occurences").alias("c"))
    total = float(sums.agg(F.sum("c")).first()[0] or 0)
    i = sums.withColumnRenamed("c", "ci")
    j = sums.select(F.col("condition").alias("conditional"), F.col("c").alias("cj"))
    n, zero = F.col("occurences"), F.lit(0.0)
    if wanted is not None:
        pairs = pairs.join(wanted, ["condition", "conditional"], "left_semi")
    rest = (F.col("cj") - n) / F.nullif(F.lit(total) - F.col("ci"), zero)
    return pairs.join(i, "condition").join(j, "conditional").select("condition", "conditional", "occurences", ((n / F.col("ci")) / F.nullif(rest, zero)).alias("factor"))
