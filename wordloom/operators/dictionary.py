"""A bounded dictionary of suggestion lists, and scores of the string n-gram generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.editdistance import list_distance
from wordloom.operators.corpus import ordered_scan
from wordloom.storage import materialize

N_SUG, N_MAX = 5, 200_000


def parent_of(prefix: str = "prefix"):
    """A prefix without its first word; '' for one word."""
    return F.when(F.instr(prefix, " ") > 0, F.regexp_replace(prefix, "^[^ ]* ", "")).otherwise(F.lit(""))


def top_followers(ngrams: DataFrame, k: int = N_SUG) -> DataFrame:
    """prefix, total and suggestions: the k most frequent followers in order (equals by word)."""
    w = Window.partitionBy("prefix").orderBy(F.desc("occurences"), F.asc("follower"))
    best = ngrams.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    lists = best.groupBy("prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "follower"))), lambda x: x["follower"]).alias("suggestions"))
    totals = ngrams.groupBy("prefix").agg(F.sum("occurences").alias("total"))
    return totals.join(lists, "prefix")


def suggestion_dictionary(lists: DataFrame, at_large: list[str], capacity: int = N_MAX) -> DataFrame:
    """prefix, suggestions, value: the ``capacity`` most valuable prefixes.

    A prefix is worth its occurrences times the distance of its list from that of the
    next shorter prefix (for one word, from the words at large).  A prefix that finds
    no room leaves its value to the nearest shorter prefix that has.  This is the
    order-free form of an eviction that, one prefix at a time, depends on their order;
    equal values go by prefix.
    """
    named = lists.withColumn("parent", parent_of())
    above = lists.select(F.col("prefix").alias("parent"), F.col("suggestions").alias("above"))
    large = F.array(*map(F.lit, at_large)) if at_large else F.array().cast("array<string>")
    valued = named.join(above, "parent", "left").withColumn("above", F.coalesce("above", large))
    valued = valued.withColumn("value", F.col("total") * list_distance(F.col("suggestions"), F.col("above"))).select("prefix", "parent", "suggestions", "value")
    ranked = ordered_scan(valued, [F.desc("value"), F.asc("prefix")])
    kept, evicted = ranked.where(F.col("row_no") < capacity), ranked.where(F.col("row_no") >= capacity)
    names = kept.select(F.col("prefix").alias("heir"), F.lit(True).alias("is_kept"))
    heirs = None
    moving = evicted.select(F.col("parent").alias("heir"), "value")
    for _ in range(3):  # a prefix has at most four words
        asked = moving.where("heir <> ''").groupBy("heir").agg(F.sum("value").alias("value")).join(names, "heir", "left")
        got = asked.where("is_kept").select("heir", "value")
        heirs = got if heirs is None else heirs.unionByName(got)
        moving = asked.where("is_kept is null").select(parent_of("heir").alias("heir"), "value")
    gained = heirs.groupBy(F.col("heir").alias("prefix")).agg(F.sum("value").alias("gained"))
    return kept.join(gained, "prefix", "left").select("prefix", "suggestions", (F.col("value") + F.coalesce("gained", F.lit(0))).alias("value"))


def dictionary_stats(dictionary: DataFrame) -> DataFrame:
    return dictionary.agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("value"), F.lit(0)).alias("total_value"))


def lookup(contexts: DataFrame, dictionary: DataFrame, longest: int = 4) -> DataFrame:
    """ctx_id, prefix, suggestions of the longest stored end of a context's words; null where none is stored.

    ``contexts``: ctx_id, words (array of strings).
    """
    ends = contexts.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(longest)))).where(F.col("n") <= F.size("words"))
    ends = ends.withColumn("prefix", F.array_join(F.slice("words", F.size("words") - F.col("n") + 1, F.col("n")), " "))
    hits = ends.join(dictionary.select("prefix", "suggestions"), "prefix")
    best = hits.groupBy("ctx_id").agg(F.max_by(F.struct("prefix", "suggestions"), "n").alias("b")).select("ctx_id", "b.*")
    return contexts.select("ctx_id").join(best, "ctx_id", "left")


def ml_probabilities(ngrams: DataFrame) -> DataFrame:
    """n, prefix, follower, p = occurrences / occurrences of the prefix."""
    w = Window.partitionBy("n", "prefix")
    return ngrams.select("n", "prefix", "follower", (F.col("occurences") / F.sum("occurences").over(w)).alias("p"))


def continuation_counts(ngrams: DataFrame) -> DataFrame:
    """n, follower, prefixes: in how many prefixes of n words a follower occurs."""
    return ngrams.groupBy("n", "follower").agg(F.count(F.lit(1)).alias("prefixes"))


def kneser_ney(ngrams: DataFrame, longest: int = 4) -> DataFrame:
    """n, prefix, follower, p: interpolated Kneser-Ney over the candidates of each prefix.

    From each follower up to d = int(mean count / 2) occurrences are borrowed (none
    for one word) and given back in proportion to the shorter prefix's probability
    over the follower's continuation count.  Computed length by length.
    """
    out = shorter = None
    cont = continuation_counts(ngrams)
    for n in range(1, longest + 1):
        w = Window.partitionBy("prefix")
        level = ngrams.where(F.col("n") == n).withColumn("cu", F.sum("occurences").over(w)).withColumn("t", F.count(F.lit(1)).over(w))
        d = F.floor(F.col("cu") / F.col("t") / 2) if n > 1 else F.lit(0).cast("bigint")
        level = level.withColumn("d", d).withColumn("p", F.greatest(F.col("occurences") - F.col("d"), F.lit(0)) / F.col("cu"))
        if n > 1:
            before = shorter.select(F.col("prefix").alias("parent"), "follower", F.col("p").alias("p_prev"))
            level = level.withColumn("parent", parent_of()).join(before, ["parent", "follower"], "left").join(cont.where(F.col("n") == n).drop("n"), "follower")
            level = level.withColumn("weight", F.coalesce("p_prev", F.lit(0.0)) / F.col("prefixes"))
            level = level.withColumn("borrowed", F.sum(F.least("occurences", "d")).over(w)).withColumn("total", F.sum("weight").over(w))
            share = F.when(F.col("total") > 0, F.col("borrowed") / F.col("cu") / F.col("total")).otherwise(F.lit(0.0))
            level = level.withColumn("p", F.col("p") + share * F.col("weight"))
        shorter = level.select("n", "prefix", "follower", "p")
        out = shorter if out is None else out.unionByName(shorter)
    return out


def combined_scores(contexts: DataFrame, probabilities: DataFrame, factors: DataFrame | Callable[[DataFrame], DataFrame], longest: int = 4) -> DataFrame:
    """ctx_id, follower, score = p * odds / (1 + odds) for the followers of the longest stored end.

    ``contexts``: ctx_id, words (array of ids).  ``probabilities``: n, prefix (joined
    ids), follower, p.  The odds are the product over the context of ``factors``
    (condition, conditional, factor); a missing or null factor counts as 1.  A function
    gets the distinct pairs that are asked for and gives the factors of these.
    """
    ends = contexts.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(longest)))).where(F.col("n") <= F.size("words"))
    cut = F.slice("words", F.size("words") - F.col("n") + 1, F.col("n"))
    ends = ends.select("ctx_id", F.col("n").cast("bigint").alias("n"), F.array_join(F.transform(cut, lambda x: x.cast("string")), " ").alias("prefix"))
    stored = probabilities.select("n", "prefix").distinct()
    best = ends.join(stored, ["n", "prefix"]).groupBy("ctx_id").agg(F.max_by("prefix", "n").alias("prefix"), F.max("n").alias("n"))
    offered = materialize(best.join(probabilities, ["n", "prefix"]).select("ctx_id", "follower", "p"), "offered")
    at = contexts.select("ctx_id", F.posexplode("words").alias("pos", "condition"))
    pairs = offered.select("ctx_id", "follower").join(at, "ctx_id").withColumnRenamed("follower", "conditional")
    if not isinstance(factors, DataFrame):
        factors = factors(pairs.select("condition", "conditional").distinct())
    hits = pairs.join(factors.where("factor is not null").select("condition", "conditional", "factor"), ["condition", "conditional"])
    odds = hits.groupBy("ctx_id", F.col("conditional").alias("follower")).agg(F.array_sort(F.collect_list(F.struct("pos", "factor"))).alias("f"))
    odds = odds.select("ctx_id", "follower", F.aggregate("f", F.lit(1.0), lambda a, x: a * x["factor"]).alias("odds"))
    scored = offered.join(odds, ["ctx_id", "follower"], "left")
    return scored.select("ctx_id", "follower", F.when(F.col("odds").isNull(), F.col("p")).otherwise(F.col("p") * F.col("odds") / (1 + F.col("odds"))).alias("score"))


def score_choices(scores: DataFrame, choices: DataFrame) -> DataFrame:
    """Per choice (ctx_id, follower) its score and place among the context's positive scores; null if not offered."""
    w = Window.partitionBy("ctx_id").orderBy(F.desc("score"), F.desc("follower"))
    ranked = scores.where("score > 0").withColumn("place", F.row_number().over(w).cast("bigint"))
    return choices.join(ranked, ["ctx_id", "follower"], "left").select("ctx_id", "follower", "score", "place")
