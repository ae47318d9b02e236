"""Queries that build and prune the model: pairs, prefixes, n-grams, clean-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import cleanup, cooccur, ngrams
from wordloom.sources.tables import table
from wordloom.storage import materialize, release


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Encoded sentences, each delivered once: sent_id, words (unknown words dropped)."""
    rows = table(spark, d, "sentence_t").select("sent_id", F.filter("words", lambda x: x.isNotNull()).alias("words"))
    return rows.where("sent_id is not null and words is not null").distinct()


def token_words(spark: SparkSession, d: str) -> DataFrame:
    """id and occurences of every word in the sentences."""
    return sentences(spark, d).select(F.explode("words").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("occurences"))


def path_text(path: str):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), " ")


def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.pair_counts(sentences(spark, d))


def bayes_factors(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.bayes_factors(pair_counts(spark, d), materialize(token_words(spark, d), "token-words"))


def pair_counts_multiset(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.pair_counts_multiset(sentences(spark, d))


def bayes_factors_rowsum(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.row_sum_factors(materialize(pair_counts_multiset(spark, d), "multiset-pairs"))


def prefix_followers(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.prefix_followers(sentences(spark, d)).select(path_text("path").alias("path"), "follower", "occurences")


def prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    tree = ngrams.prefix_tree(materialize(ngrams.prefix_followers(sentences(spark, d)), "followers"))
    return tree.withColumn("path", path_text("path"))


def ngram_factors(spark: SparkSession, d: str) -> DataFrame:
    followers = materialize(ngrams.prefix_followers(sentences(spark, d)), "followers")
    tree = materialize(ngrams.prefix_tree(followers), "tree")
    return ngrams.ngram_factors(followers, tree, materialize(token_words(spark, d), "token-words"))


def trie_counts(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.path_counts(sentences(spark, d)).select(path_text("path").alias("path"), "occurences")


def merged_tries(spark: SparkSession, d: str) -> DataFrame:
    """Tries of the even and the odd sentences, merged."""
    s = sentences(spark, d)
    halves = [ngrams.path_counts(s.where(F.pmod("sent_id", F.lit(2)) == k)) for k in (0, 1)]
    return ngrams.merge_trees(*halves).select(path_text("path").alias("path"), "occurences")


def frequent_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """N-grams of up to four words seen five times, counted level by level."""
    return ngrams.frequent_ngrams(sentences(spark, d), 4, 5).select("n", path_text("ngram").alias("ngram"), "occurences")


def stored(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The stored model with one row per key: the latest delivery counts."""
    words = table(spark, d, "word_t").select("id", "word", "occurences", "loaded_at").where("id is not null").distinct()
    bayes = table(spark, d, "bayes_t").where("condition is not null and conditional is not null")
    bayes = cleanup.newest(bayes, ["condition", "conditional"], ["loaded_at", "row_id"]).select("condition", "conditional", "occurences", "factor")
    prefixes = table(spark, d, "prefix_t").select("id", "parent", "word", "occurences").where("id is not null").distinct()
    grams = table(spark, d, "ngram_t").where("prefix is not null and follower is not null")
    grams = cleanup.newest(grams, ["prefix", "follower"], ["loaded_at", "row_id"]).select("prefix", "follower", "occurences", "factor")
    return {"words": words.select("id", "word", "occurences"), "bayes": bayes, "prefixes": prefixes, "ngrams": grams}


def pruned(spark: SparkSession, d: str, write: bool = False) -> dict[str, DataFrame]:
    t = stored(spark, d)
    if not write:
        return cleanup.cleanup(t["words"], t["bayes"], t["prefixes"], t["ngrams"])
    t |= {k: materialize(t[k], f"stored-{k}") for k in ("words", "prefixes")}
    made = [t["words"], t["prefixes"]]

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(materialize(df, name))
        return made[-1]

    out = cleanup.cleanup(t["words"], t["bayes"], t["prefixes"], t["ngrams"], keep=keep)
    release(*[x for x in made if not any(x is y for y in out.values())])
    return out


def _cleaned(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: pruned(spark, d)[name]


def prefix_levels(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes per level, 1 to 4."""
    return cleanup.prefix_levels(stored(spark, d)["prefixes"]).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def model_counts(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.model_counts(pruned(spark, d, write=True))


def remap_words(spark: SparkSession, d: str) -> DataFrame:
    t = pruned(spark, d, write=True)
    return cleanup.remap(t["words"], {"id": cleanup.dense_ids(t["words"])})


def remap_ngrams(spark: SparkSession, d: str) -> DataFrame:
    t = pruned(spark, d, write=True)
    words, prefixes = cleanup.dense_ids(t["words"]), cleanup.dense_ids(t["prefixes"])
    return cleanup.remap(t["ngrams"], {"prefix": prefixes, "follower": words})


def remap_prefixes(spark: SparkSession, d: str) -> DataFrame:
    t = pruned(spark, d, write=True)
    words, prefixes = cleanup.dense_ids(t["words"]), cleanup.dense_ids(t["prefixes"])
    return cleanup.remap(t["prefixes"], {"id": prefixes, "parent": prefixes, "word": words}, keep_missing={"parent": -1})


def remap_bayes(spark: SparkSession, d: str) -> DataFrame:
    t = pruned(spark, d, write=True)
    words = materialize(cleanup.dense_ids(t["words"]), "word-ids")
    return cleanup.remap(t["bayes"], {"condition": words, "conditional": words})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f.__name__: f for f in (pair_counts, bayes_factors, pair_counts_multiset, bayes_factors_rowsum, prefix_followers, prefix_trie, ngram_factors, trie_counts, merged_tries, frequent_ngrams)},
    "prefix_levels": prefix_levels,
    **{f"cleanup_{name}": _cleaned(name) for name in ("words", "bayes", "prefixes", "ngrams")},
    **{f.__name__: f for f in (model_counts, remap_words, remap_bayes, remap_prefixes, remap_ngrams)},
}

SENTENCES = """
s AS (SELECT DISTINCT sent_id, [x FOR x IN words IF x IS NOT NULL] AS w FROM sentence_t WHERE sent_id IS NOT NULL AND words IS NOT NULL),
tok AS (SELECT sent_id, unnest(w) AS id, unnest(range(len(w))) AS pos FROM s),
tw AS (SELECT id, count(*) AS occurences FROM tok GROUP BY id),
t AS (SELECT CAST(sum(occurences) AS DOUBLE) AS t FROM tw)"""
_ONE = f"WITH {SENTENCES}, one AS (SELECT DISTINCT sent_id, id FROM tok)"
_PAIRS = f"""{_ONE},
pairs AS (SELECT a.id AS condition, b.id AS conditional, count(*) AS occurences FROM one a JOIN one b ON a.sent_id = b.sent_id AND a.id <> b.id GROUP BY 1, 2 HAVING count(*) >= 2)"""
_MULTI = f"""WITH {SENTENCES},
half AS (SELECT a.id AS a, b.id AS b FROM tok a JOIN tok b ON a.sent_id = b.sent_id AND a.pos < b.pos),
pairs AS (SELECT condition, conditional, count(*) AS occurences FROM (SELECT a AS condition, b AS conditional FROM half UNION ALL SELECT b, a FROM half WHERE a <> b) GROUP BY 1, 2)"""
FOLLOWERS = f"""WITH {SENTENCES},
spots AS (SELECT w, unnest(range(2, len(w) + 1)) AS p FROM s),
paths AS (SELECT list_reverse(w[p - k:p - 1]) AS path, w[p] AS follower FROM spots, (VALUES (1), (2), (3), (4)) AS v(k) WHERE p > k),
f AS (SELECT path, follower, count(*) AS occurences FROM paths GROUP BY 1, 2)"""
TREE = f"""{FOLLOWERS},
totals AS (SELECT path, CAST(sum(occurences) AS BIGINT) AS occurences, count(*) FILTER (occurences > 1) AS kept FROM f GROUP BY path),
visited AS (SELECT x.* FROM totals x WHERE x.occurences > 1 AND (len(x.path) = 1 OR EXISTS (SELECT 1 FROM totals y WHERE y.kept > 0 AND y.path = x.path[1:len(x.path) - 1]))),
numbered AS (SELECT row_number() OVER (ORDER BY path) - 1 AS id, * FROM visited),
tree AS (SELECT x.path, x.id, coalesce(y.id, -1) AS parent, x.path[-1] AS word, len(x.path) AS level, x.occurences
         FROM numbered x LEFT JOIN numbered y ON y.kept > 0 AND len(x.path) > 1 AND y.path = x.path[1:len(x.path) - 1] WHERE x.kept > 0)"""
_TRIE = f"""WITH {SENTENCES},
spots AS (SELECT w, unnest(range(1, len(w) + 1)) AS p FROM s),
paths AS (SELECT list_reverse(w[p - k + 1:p]) AS path FROM spots, (VALUES (1), (2), (3), (4)) AS v(k) WHERE p >= k)
SELECT array_to_string(path, ' ') AS path, count(*) AS occurences FROM paths GROUP BY 1"""
_LEVELS = "".join(f"l{k} AS (SELECT DISTINCT id FROM p0 WHERE parent IN (SELECT id FROM l{k - 1}))," for k in (2, 3, 4))
_BAND = "factor IS NOT NULL AND NOT isnan(factor)"
CLEAN = f"""
w0 AS (SELECT id, word, occurences FROM (SELECT DISTINCT id, word, occurences, loaded_at FROM word_t WHERE id IS NOT NULL)),
b0 AS (SELECT condition, conditional, occurences, factor FROM bayes_t WHERE condition IS NOT NULL AND conditional IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY condition, conditional ORDER BY loaded_at DESC NULLS LAST, row_id DESC) = 1),
p0 AS (SELECT DISTINCT id, parent, word, occurences FROM prefix_t WHERE id IS NOT NULL),
n0 AS (SELECT prefix, follower, occurences, factor FROM ngram_t WHERE prefix IS NOT NULL AND follower IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY prefix, follower ORDER BY loaded_at DESC NULLS LAST, row_id DESC) = 1),
l1 AS (SELECT DISTINCT id FROM p0 WHERE parent = -1), {_LEVELS}
lev AS (SELECT id, min(level) AS level FROM (SELECT id, CAST(1 AS BIGINT) AS level FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3 UNION ALL SELECT id, 4 FROM l4) GROUP BY id),
p1 AS (SELECT * FROM p0 WHERE id NOT IN (SELECT id FROM lev WHERE level = 4)),
n1 AS (SELECT * FROM n0 WHERE {_BAND} AND (factor < 0.5 OR factor > 2)),
b1 AS (SELECT condition, conditional, factor FROM b0 WHERE {_BAND} AND (factor < 0.04 OR factor > 25) AND condition IN (SELECT id FROM w0) AND conditional IN (SELECT id FROM w0)),
p2 AS (SELECT * FROM p1 WHERE word IN (SELECT id FROM w0) AND id IN (SELECT prefix FROM n1)),
p3 AS (SELECT * FROM p2 WHERE parent = -1 OR parent IN (SELECT id FROM p2)),
n2 AS (SELECT * FROM n1 WHERE prefix IN (SELECT id FROM p3) AND follower IN (SELECT id FROM w0)),
w1 AS (SELECT * FROM w0 WHERE id IN (SELECT condition FROM b1 UNION ALL SELECT conditional FROM b1 UNION ALL SELECT word FROM p3 UNION ALL SELECT follower FROM n2)),
wid AS (SELECT id, row_number() OVER (ORDER BY id) AS new FROM (SELECT DISTINCT id FROM w1)),
pid AS (SELECT id, row_number() OVER (ORDER BY id) AS new FROM (SELECT DISTINCT id FROM p3))"""

SQL: dict[str, str] = {
    "pair_counts": _PAIRS + " SELECT * FROM pairs",
    "bayes_factors": _PAIRS
    + """ SELECT condition, conditional, p.occurences, ((SELECT t FROM t) / e.occurences - 1) / nullif(c.occurences / p.occurences - 1, 0) AS factor
FROM pairs p JOIN tw c ON c.id = condition JOIN tw e ON e.id = conditional""",
    "pair_counts_multiset": _MULTI + " SELECT * FROM pairs",
    "bayes_factors_rowsum": _MULTI
    + """, c AS (SELECT condition AS id, CAST(sum(occurences) AS BIGINT) AS c FROM pairs GROUP BY 1), total AS (SELECT CAST(sum(c) AS DOUBLE) AS t FROM c)
SELECT condition, conditional, occurences, (occurences / i.c) / nullif((j.c - occurences) / nullif((SELECT t FROM total) - i.c, 0), 0) AS factor
FROM pairs JOIN c i ON i.id = condition JOIN c j ON j.id = conditional""",
    "prefix_followers": FOLLOWERS + " SELECT array_to_string(path, ' ') AS path, follower, occurences FROM f",
    "prefix_trie": TREE + " SELECT array_to_string(path, ' ') AS path, id, parent, word, level, occurences FROM tree",
    "ngram_factors": TREE
    + """ SELECT x.id AS prefix, f.follower, f.occurences, ((SELECT t FROM t) / e.occurences - 1) / nullif(x.occurences / f.occurences - 1, 0) AS factor
FROM f JOIN tree x ON x.path = f.path JOIN tw e ON e.id = f.follower WHERE f.occurences > 1""",
    "trie_counts": _TRIE,
    "merged_tries": _TRIE,
    "frequent_ngrams": f"""WITH {SENTENCES},
spots AS (SELECT w, unnest(range(1, len(w) + 1)) AS p FROM s)
SELECT n, array_to_string(w[p:p + n - 1], ' ') AS ngram, count(*) AS occurences FROM spots, (VALUES (CAST(1 AS BIGINT)), (2), (3), (4)) AS v(n) WHERE p + n - 1 <= len(w) GROUP BY 1, 2 HAVING count(*) >= 5""",
    "prefix_levels": f"WITH {CLEAN} SELECT level, count(*) AS n FROM lev GROUP BY level",
    "cleanup_words": f"WITH {CLEAN} SELECT * FROM w1",
    "cleanup_bayes": f"WITH {CLEAN} SELECT * FROM b1",
    "cleanup_prefixes": f"WITH {CLEAN} SELECT * FROM p3",
    "cleanup_ngrams": f"WITH {CLEAN} SELECT * FROM n2",
    "model_counts": f"""WITH {CLEAN} SELECT 'words' AS name, count(*) AS n FROM w1 UNION ALL SELECT 'bayes', count(*) FROM b1
UNION ALL SELECT 'prefixes', count(*) FROM p3 UNION ALL SELECT 'ngrams', count(*) FROM n2""",
    "remap_words": f"WITH {CLEAN} SELECT wid.new AS id, word, occurences FROM w1 JOIN wid USING (id)",
    "remap_bayes": f"WITH {CLEAN} SELECT c.new AS condition, e.new AS conditional, factor FROM b1 JOIN wid c ON c.id = condition JOIN wid e ON e.id = conditional",
    "remap_prefixes": f"""WITH {CLEAN} SELECT i.new AS id, CASE WHEN parent = -1 THEN -1 ELSE q.new END AS parent, w.new AS word, occurences
FROM p3 JOIN pid i ON i.id = p3.id LEFT JOIN pid q ON q.id = parent JOIN wid w ON w.id = p3.word WHERE parent = -1 OR q.new IS NOT NULL""",
    "remap_ngrams": f"WITH {CLEAN} SELECT p.new AS prefix, f.new AS follower, occurences, factor FROM n2 JOIN pid p ON p.id = prefix JOIN wid f ON f.id = follower",
}
