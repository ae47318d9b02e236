"""Prefixes read backwards, their followers, the stored prefix tree and its factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.cooccur import odds_factor
from wordloom.operators.corpus import ordered_scan
from wordloom.storage import materialize

MAX_PREFIX = 4


def prefix_followers(sentences: DataFrame, max_prefix: int = MAX_PREFIX, words: str = "words") -> DataFrame:
    """Counts of (path, follower): the 1 to ``max_prefix`` words before a word, last word first.

    Null words are left out before positions are counted.
    """
    w = sentences.select(F.filter(F.col(words), lambda x: x.isNotNull()).alias("w")).where(F.size("w") > 1)
    at = w.select("w", F.explode(F.sequence(F.lit(2), F.size("w"))).alias("p"))
    before = F.reverse(F.slice("w", F.greatest(F.col("p") - max_prefix, F.lit(1)), F.least(F.col("p") - 1, F.lit(max_prefix))))
    longest = at.select(before.alias("b"), F.element_at("w", F.col("p")).alias("follower"))
    # The longest paths are counted first; shorter ones are sums of these, so each event is aggregated once.
    counted = longest.groupBy("b", "follower").agg(F.count(F.lit(1)).alias("n"))
    each = counted.select("follower", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("b")), lambda k: F.slice("b", 1, k))).alias("path"))
    return each.groupBy("path", "follower").agg(F.sum("n").alias("occurences"))


def prefix_totals(followers: DataFrame) -> DataFrame:
    """Occurrences of each path before anything is pruned, and its followers seen at least twice."""
    return followers.groupBy("path").agg(F.sum("occurences").alias("occurences"), F.count_if(F.col("occurences") > 1).alias("kept"))


def prefix_tree(followers: DataFrame) -> DataFrame:
    """Stored nodes: path, id, parent, word, level, occurences.

    A path is visited if it occurs twice and its parent is stored, and stored if one
    of its followers occurs twice; then all its ancestors are stored as well.  Ids
    number the visited paths in depth-first order, so that unstored ones leave gaps.
    """
    totals = prefix_totals(followers)
    stored = totals.where("kept > 0").select(F.col("path").alias("parent_path"))
    seen = totals.where("occurences > 1").withColumn("parent_path", F.slice("path", 1, F.size("path") - 1))
    visited = seen.join(stored, "parent_path", "left_semi").unionByName(seen.where(F.size("path") == 1)).select("path", "occurences", "kept")
    numbered = ordered_scan(visited, [F.col("path")]).where("kept > 0")
    ids = numbered.select(F.col("path").alias("parent_path"), F.col("row_no").alias("parent"))
    nodes = numbered.withColumn("parent_path", F.slice("path", 1, F.size("path") - 1)).join(ids, "parent_path", "left")
    return nodes.select(
        "path", F.col("row_no").alias("id"), F.coalesce("parent", F.lit(-1)).alias("parent"), F.element_at("path", -1).alias("word"),
        F.size("path").cast("bigint").alias("level"), "occurences",
    )


def ngram_factors(followers: DataFrame, tree: DataFrame, words: DataFrame) -> DataFrame:
    """Stored n-grams with their factor: prefix (id), follower, occurences, factor."""
    total = float(words.agg(F.sum("occurences")).first()[0] or 0)
    nodes = tree.select("path", F.col("id").alias("prefix"), F.col("occurences").alias("occ_prefix"))
    outcome = words.select(F.col("id").alias("follower"), F.col("occurences").alias("occ_follower"))
    kept = followers.where("occurences > 1").join(nodes, "path").join(outcome, "follower", "left")
    factor = odds_factor(total, F.col("occ_follower"), F.col("occ_prefix"), F.col("occurences"))
    return kept.select("prefix", "follower", "occurences", factor.alias("factor"))


def path_counts(sentences: DataFrame, max_length: int = MAX_PREFIX, words: str = "words") -> DataFrame:
    """Counts of all backward paths, the last word of each first, sentence ends included (the trie of n-grams)."""
    w = sentences.select(F.filter(F.col(words), lambda x: x.isNotNull()).alias("w")).where(F.size("w") > 0)
    at = w.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("p"))
    longest = at.select(F.reverse(F.slice("w", F.greatest(F.col("p") - (max_length - 1), F.lit(1)), F.least(F.col("p"), F.lit(max_length)))).alias("b"))
    counted = longest.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    each = counted.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size("b")), lambda k: F.slice("b", 1, k))).alias("path"))
    return each.groupBy("path").agg(F.sum("n").alias("occurences"))


def frequent_ngrams(sentences: DataFrame, n: int, min_count: int, words: str = "words") -> DataFrame:
    """N-grams of 1..n words seen ``min_count`` times, level by level: an n-gram is only counted where its first n-1 words are frequent."""
    w = sentences.select(F.filter(F.col(words), lambda x: x.isNotNull()).alias("w"))
    found, before = None, None
    for length in range(1, n + 1):
        at = w.where(F.size("w") >= length).select("w", F.explode(F.sequence(F.lit(1), F.size("w") - (length - 1))).alias("p"))
        grams = at.select(F.slice("w", F.col("p"), length).alias("ngram"))
        if before is not None:
            grams = grams.withColumn("head", F.slice("ngram", 1, length - 1)).join(before, "head", "left_semi")
        level = grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("occurences")).where(F.col("occurences") >= min_count)
        before = level.select(F.col("ngram").alias("head"))
        level = level.select(F.lit(length).cast("bigint").alias("n"), "ngram", "occurences")
        found = level if found is None else found.unionByName(level)
    return found


def fixed_ngrams(rows: DataFrame, n: int, ignore: tuple[str, ...] = ("_", ","), sentence: str = "sentence") -> DataFrame:
    """String prefixes of ``n`` words and the word after them: n, prefix, follower, occurences."""
    w = rows.select(F.split(sentence, " ").alias("w")).where(F.size("w") > n)
    at = w.select("w", F.explode(F.sequence(F.lit(1), F.size("w") - n)).alias("p"))
    pairs = at.select(F.array_join(F.slice("w", F.col("p"), n), " ").alias("prefix"), F.element_at("w", F.col("p") + n).alias("follower"))
    pairs = pairs.where(~F.col("follower").isin(list(ignore)))
    return pairs.groupBy("prefix", "follower").agg(F.count(F.lit(1)).alias("occurences")).select(F.lit(n).cast("bigint").alias("n"), "prefix", "follower", "occurences")


def merge_trees(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two counted trees as one: counts of equal paths add up."""
    return one.select("path", "occurences").unionByName(other.select("path", "occurences")).groupBy("path").agg(F.sum("occurences").alias("occurences"))


def move_subtree(tree: DataFrame, source: Sequence[int], target: Sequence[int]) -> DataFrame:
    """The tree (path, occurences) with the node ``source`` and all below it moved to ``target``.

    Where the target has a node of the same word under the same parent the two become
    one and their counts add up, all the way down.
    """
    under = F.slice("path", 1, len(source)) == F.array(*map(F.lit, source)).cast("array<bigint>")
    moved = F.concat(F.array(*map(F.lit, target)).cast("array<bigint>"), F.slice("path", F.lit(len(source) + 1), F.size("path")))
    return tree.select(F.when(under, moved).otherwise(F.col("path")).alias("path"), "occurences").groupBy("path").agg(F.sum("occurences").alias("occurences"))


def number_tree(tree: DataFrame) -> DataFrame:
    """Add id, in depth-first order from 0, and parent (-1 at the top or where the path above is not stored)."""
    numbered = materialize(ordered_scan(tree.select("path", "occurences"), [F.col("path")]).withColumnRenamed("row_no", "id"), "numbered-tree")
    above = numbered.select(F.col("path").alias("up"), F.col("id").alias("parent"))
    return numbered.withColumn("up", F.slice("path", 1, F.size("path") - 1)).join(above, "up", "left").select("path", "id", F.coalesce("parent", F.lit(-1)).alias("parent"), "occurences")
