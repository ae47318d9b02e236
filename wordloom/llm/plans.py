"""The training-data problems as queries over the project's tables (p1, p3, p5, p7, p8, p9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import mixing, packing, residue, suffixes, topn
from wordloom.llm.pairs import PairTable
from wordloom.llm.tokens import token_count
from wordloom.session import spread
from wordloom.sources.tables import table
from wordloom.storage import materialize

# p1: terms

#: Too rare: below the first total, or below the second in a single record. Too common: more than one in so many.
RARE_TOTAL, RARE_SINGLE, COMMON_ONE_IN = 3, 6, 200


def term(word):
    """A spelling without blanks at its ends, apostrophes unified, in lower case."""
    bare = F.btrim(word, F.lit(" \t\xa0"))
    return F.lower(F.translate(bare, "\u2018\u2019\u02bc", "'''"))


def _marked(counted: DataFrame, whole) -> DataFrame:
    rare = (F.col("total") < RARE_TOTAL) | ((F.col("total") < RARE_SINGLE) & (F.col("records") == 1))
    common = F.col("total") * COMMON_ONE_IN > whole
    return counted.withColumn("mark", F.when(common, "common").when(rare, "rare").otherwise("kept"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "word_t").select("id", "word", "occurences", "source", "loaded_at", "deleted_at").distinct()
    rows = rows.select(term(F.col("word")).alias("term"), "occurences").where("term <> ''")
    counted = suffixes.ngram_frequencies(rows.select(F.array("term").alias("terms"), "occurences"), "terms", 1, "occurences")
    counted = materialize(counted.select(F.col("ngram")[0].alias("term"), "total", "records"), "terms")
    whole = counted.agg(F.sum("total")).first()[0] or 0
    return _marked(counted, F.lit(whole))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark <> 'kept'").select("term")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with total, record count and mark."""
    return _terms(spark, d)


def p1_phrases(spark: SparkSession, d: str) -> DataFrame:
    """All sequences of up to three words of the sentences: how often, in how many sentences, and marked as terms are (common: among those as long)."""
    s = table(spark, d, "sentence_t").select("sent_id", "words").where("sent_id is not null").distinct()
    ids = s.select(F.transform("words", lambda x: x.cast("string")).alias("terms"))
    counted = materialize(suffixes.ngram_frequencies(ids, "terms", 3), "phrases")
    whole = counted.groupBy("n").agg(F.sum("total").alias("whole"))
    return _marked(counted.join(F.broadcast(whole), "n"), F.col("whole")).select(F.array_join("ngram", " ").alias("phrase"), F.col("n").cast("bigint").alias("n"), "total", "records", "mark")


# p3: pairs

MIN_TOGETHER, MIN_LIFT = 5, 6.5
#: The sentences arrive in this many batches of blocks.
BATCHES = 2


def _baskets(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Sentences as baskets, and the last block."""
    s = table(spark, d, "sentence_t").select(F.col("sent_id").alias("basket"), "words", F.col("loaded_at").alias("at"), F.coalesce("block", F.lit(0)).alias("block"))
    return s, max(s.agg(F.max("block")).first()[0] or 0, 0)


def _pair_table(spark: SparkSession, d: str) -> PairTable:
    s, last = _baskets(spark, d)
    pairs = PairTable(spark)
    for k in range(BATCHES):
        part = F.greatest(F.lit(0), F.floor(F.col("block") * BATCHES / (last + 1)))
        pairs.apply(s.where(part == k))
    return pairs


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    scores = _pair_table(spark, d).scores(MIN_TOGETHER)
    # The same division as in the problem's statement decides at the border.
    return scores.where(F.col("lift") >= MIN_LIFT).select("word_a", "word_b")


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pairs seen in five sentences or more, with their counts and ratio to chance."""
    return _pair_table(spark, d).scores(MIN_TOGETHER).withColumn("lift", F.round("lift", 6))


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    """The scores to compute anew after a change: the first block is withdrawn, the last one comes again without its sentences' last words."""
    s, last = _baskets(spark, d)
    pairs = PairTable(spark).apply(s)
    PairTable(spark, pairs.path).apply(
        s.where("block <= 0").withColumn("words", F.lit(None).cast("array<bigint>"))
        .unionByName(s.where((F.col("block") == last) & (F.col("block") > 0)).withColumn("words", F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0)))))
    )
    return PairTable(spark, pairs.path).affected_scores(MIN_TOGETHER).withColumn("lift", F.round("lift", 6))


# p5: top followers

TOP = 3


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _followers(spark, d).select("prefix", "follower")


def _followers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ngram_t").select("prefix", "follower", "factor", "occurences", "loaded_at", "row_id")
    rows = topn.latest(rows.where("prefix is not null and follower is not null"), ["prefix", "follower"], ["loaded_at", "row_id"])
    rows = rows.where("factor is null or not isnan(factor)")
    order = [F.col("factor").desc_nulls_first(), F.col("occurences").desc_nulls_last(), F.col("follower").asc()]
    return topn.top_n(rows, ["prefix"], order, TOP)


def p5_top_followers(spark: SparkSession, d: str) -> DataFrame:
    """The three best followers per prefix with their rank."""
    return _followers(spark, d).select("prefix", "follower", F.col("rank").cast("bigint").alias("rank"), "occurences", "factor")


# p7: containers


def _assignment(spark: SparkSession, d: str) -> DataFrame:
    kinds = {r["container"]: r["capacity_tokens"] for r in table(spark, d, "container_t").where("capacity_tokens > 0").collect()}
    texts = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", token_count(F.col("text")).alias("tokens"))
    return packing.pack(texts, "doc_id", "tokens", kinds)


def p7_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _assignment(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and share filled per kind."""
    per = packing.fill(_assignment(spark, d))
    return per.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") / F.sum("capacity"), 6).alias("filled"), F.min("filled").alias("least_filled"),
    )


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of an assignment: per kind the documents in it, overfull containers, split documents that would fit, and pieces that do not join up."""
    rows = materialize(_assignment(spark, d), "assignment")
    over = packing.fill(rows).groupBy("container").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"))
    per = rows.groupBy("container", "capacity", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("pieces"), F.max("piece").alias("last"), F.sum("tokens").alias("t"), F.max(F.col("token_start") + F.col("tokens")).alias("end"))
    per = per.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity"))).alias("needless_splits"),
        F.count_if((F.col("n") != F.col("pieces")) | (F.col("last") + 1 != F.col("n")) | (F.col("end") != F.col("t"))).alias("broken"),
    )
    return per.join(over, "container", "left").select("container", "capacity", "documents", F.coalesce("overfull", F.lit(0)).alias("overfull"), "needless_splits", "broken")


# p8: mix


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_target_t").groupBy(mixing.source_name(F.col("source")).alias("source"))
    targets = targets.agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).where("source is not null")
    wanted = {r["source"]: (r["share"], r["cap"]) for r in targets.collect()}
    texts = table(spark, d, "documents").select("doc_id", "text", mixing.source_name(F.col("source")).alias("source"))
    texts = texts.where(F.col("source").isin(list(wanted)))
    sized = materialize(spread(texts).select("doc_id", "source", token_count(F.col("text")).alias("tokens")), "mix-sizes")
    supply = {r["source"]: r["s"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("s")).collect()}
    return mixing.mix(sized, mixing.plan_mix(supply, wanted), "doc_id", "source", "tokens"), targets


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The records in training order, one row per use."""
    return _mix(spark, d)[0]


def p8_repeats(spark: SparkSession, d: str) -> DataFrame:
    """The chosen records with the number of their uses."""
    return _mix(spark, d)[0].groupBy("doc_id", "source", "tokens").agg(F.count(F.lit(1)).alias("repeats"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per listed source the share wanted and the share reached; a source without documents reaches 0."""
    taken, targets = _mix(spark, d)
    per = taken.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("copy").alias("last"))
    per = materialize(targets.join(per, "source", "left"), "mix-shares")
    whole = per.agg(F.sum("tokens")).first()[0] or 1
    none = F.lit(0)
    return per.select(
        "source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), F.coalesce("tokens", none).alias("tokens"),
        F.coalesce("uses", none).alias("uses"), (F.coalesce("last", F.lit(-1)) + 1).alias("most_repeats"), (F.coalesce("tokens", none) / whole).alias("share"),
    )


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a mix: per listed source its cap, records used too often, records of another source, and whether the share is within half a percent."""
    taken, targets = _mix(spark, d)
    taken = materialize(taken, "mix-rows")
    owner = table(spark, d, "documents").select("doc_id", mixing.source_name(F.col("source")).alias("owner")).distinct()
    foreign = taken.join(owner, (taken.doc_id == owner.doc_id) & (taken.source == owner.owner), "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("foreign_rows"))
    uses = taken.groupBy("source", "doc_id", "copy").agg(F.count(F.lit(1)).alias("same"), F.sum("tokens").alias("t"))
    per = uses.groupBy("source").agg(F.sum("t").alias("t"), F.max("copy").alias("last"))
    whole = per.agg(F.sum("t")).first()[0] or 1
    there = [r[0] for r in per.select("source").collect()]
    wanted = targets.where(F.col("source").isin(there)).agg(F.sum("share")).first()[0] or 1
    off = F.abs(F.coalesce("t", F.lit(0)) / whole - F.when(F.col("source").isin(there), F.col("share") / wanted).otherwise(0)) > 0.005
    return targets.join(per, "source", "left").join(foreign, "source", "left").select(
        "source", F.col("cap").alias("max_repeats"), (F.coalesce("last", F.lit(-1)) + 1 > F.col("cap")).alias("over_cap"), F.coalesce("foreign_rows", F.lit(0)).alias("foreign_rows"), off.alias("off_share")
    )


# p9: residue


def _residue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text")
    dealt = spread(docs)
    return docs, residue.find_residue(dealt, "doc_id", "text", residue.fit_on(dealt, "doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d)[1].select("doc_id").distinct()


def p9_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Per document with residue: how much of it, and whether to drop the document or cut the sentences."""
    docs, spans = _residue(spark, d)
    return residue.exclusion(spans, docs, "doc_id", F.length("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_terms, p1_phrases, p3_found, p3_scores, p3_changes, p5_found, p5_top_followers, p7_assignment, p7_fill, p7_checks, p8_mix, p8_repeats, p8_shares, p8_checks, p9_found, p9_exclusion)
}

_TERMS = """
WITH rows AS (SELECT DISTINCT * FROM word_t),
terms AS (SELECT lower(translate(trim(word, ' ' || chr(9) || chr(160)), chr(8216) || chr(8217) || chr(700), '''''''')) AS term, coalesce(occurences, 0) AS o FROM rows),
totals AS (SELECT term, CAST(sum(o) AS BIGINT) AS total, count(*) AS records FROM terms WHERE term <> '' GROUP BY term),
marked AS (SELECT *, CASE WHEN total * 200 > (SELECT sum(total) FROM totals) THEN 'common'
                          WHEN total < 3 OR (total < 6 AND records = 1) THEN 'rare' ELSE 'kept' END AS mark FROM totals)
"""
_PAIRS = """
WITH s AS (SELECT sent_id, list_distinct(words) AS w FROM
           (SELECT sent_id, arg_max(words, loaded_at) AS words FROM sentence_t WHERE sent_id IS NOT NULL GROUP BY sent_id)),
one AS (SELECT sent_id, unnest(w) AS word FROM s),
n AS (SELECT word, count(*) AS n FROM one GROUP BY word),
ab AS (SELECT a.word AS word_a, b.word AS word_b, count(*) AS n_ab FROM one a JOIN one b ON a.sent_id = b.sent_id AND a.word < b.word GROUP BY 1, 2 HAVING count(*) >= 5),
scored AS (SELECT word_a, word_b, n_ab, x.n AS n_a, y.n AS n_b,
                  n_ab * (SELECT CAST(count(DISTINCT sent_id) AS DOUBLE) FROM one) / (x.n * y.n) AS lift
           FROM ab JOIN n x ON x.word = word_a JOIN n y ON y.word = word_b)
"""
_CHANGED = """
WITH s0 AS (SELECT sent_id, coalesce(block, 0) AS block, words, loaded_at FROM sentence_t WHERE sent_id IS NOT NULL),
last AS (SELECT max(block) AS b FROM s0),
gone AS (SELECT DISTINCT sent_id FROM s0 WHERE block <= 0),
before AS (SELECT sent_id, list_sort([x FOR x IN list_distinct(coalesce(arg_max(words, loaded_at), [])) IF x IS NOT NULL]) AS w FROM s0 GROUP BY sent_id),
fixed AS (SELECT sent_id, list_sort([x FOR x IN list_distinct(arg_max(words[:len(words) - 1], loaded_at)) IF x IS NOT NULL]) AS w FROM s0, last WHERE block = b AND block > 0 GROUP BY sent_id),
after AS (SELECT b.sent_id, CASE WHEN g.sent_id IS NOT NULL THEN [] WHEN f.sent_id IS NOT NULL THEN coalesce(f.w, []) ELSE b.w END AS w
  FROM before b LEFT JOIN gone g USING (sent_id) LEFT JOIN fixed f USING (sent_id)),
o AS (SELECT sent_id, unnest(w) AS word FROM before), one AS (SELECT sent_id, unnest(w) AS word FROM after),
m AS (SELECT word, count(*) AS n FROM one GROUP BY 1), mo AS (SELECT word, count(*) AS n FROM o GROUP BY 1),
moved AS (SELECT coalesce(m.word, mo.word) AS word FROM m FULL JOIN mo ON m.word = mo.word WHERE m.n IS DISTINCT FROM mo.n),
pn AS (SELECT a.word AS word_a, b.word AS word_b, count(*) AS n_ab FROM one a JOIN one b ON a.sent_id = b.sent_id AND a.word < b.word GROUP BY 1, 2),
po AS (SELECT a.word AS word_a, b.word AS word_b, count(*) AS n_ab FROM o a JOIN o b ON a.sent_id = b.sent_id AND a.word < b.word GROUP BY 1, 2)
SELECT pn.word_a, pn.word_b, pn.n_ab, x.n AS n_a, y.n AS n_b, round(pn.n_ab * (SELECT CAST(count(*) AS DOUBLE) FROM after WHERE len(w) > 0) / (x.n * y.n), 6) AS lift
FROM pn LEFT JOIN po ON po.word_a = pn.word_a AND po.word_b = pn.word_b JOIN m x ON x.word = pn.word_a JOIN m y ON y.word = pn.word_b
WHERE pn.n_ab >= 5 AND (pn.n_ab IS DISTINCT FROM po.n_ab OR pn.word_a IN (SELECT word FROM moved) OR pn.word_b IN (SELECT word FROM moved))"""
_TOP = """
WITH newest AS (SELECT * FROM ngram_t WHERE prefix IS NOT NULL AND follower IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY prefix, follower ORDER BY loaded_at DESC NULLS LAST, row_id DESC) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY factor DESC NULLS FIRST, occurences DESC NULLS LAST, follower) AS rank
           FROM newest WHERE factor IS NULL OR NOT isnan(factor))
"""

SQL: dict[str, str] = {
    "p1_found": _TERMS + "SELECT term FROM marked WHERE mark <> 'kept'",
    "p1_terms": _TERMS + "SELECT term, total, records, mark FROM marked",
    "p1_phrases": """
WITH s AS (SELECT DISTINCT sent_id, words FROM sentence_t WHERE sent_id IS NOT NULL),
t AS (SELECT sent_id, [x FOR x IN words IF x IS NOT NULL] AS w FROM s),
starts AS (SELECT sent_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
grams AS (SELECT sent_id, w[i:i + k - 1] AS g, k AS n FROM starts, (VALUES (1), (2), (3)) AS v(k) WHERE i + k - 1 <= len(w)),
counted AS (SELECT g, n, count(*) AS total, count(DISTINCT sent_id) AS records FROM grams GROUP BY g, n)
SELECT array_to_string(g, ' ') AS phrase, CAST(n AS BIGINT) AS n, total, records,
  CASE WHEN total * 200 > sum(total) OVER (PARTITION BY n) THEN 'common' WHEN total < 3 OR (total < 6 AND records = 1) THEN 'rare' ELSE 'kept' END AS mark FROM counted""",
    "p3_found": _PAIRS + "SELECT word_a, word_b FROM scored WHERE lift >= 6.5",
    "p3_scores": _PAIRS + "SELECT word_a, word_b, n_ab, n_a, n_b, round(lift, 6) AS lift FROM scored",
    "p3_changes": _CHANGED,
    "p5_found": _TOP + "SELECT prefix, follower FROM ranked WHERE rank <= 3",
    "p7_checks": """SELECT container, CAST(capacity_tokens AS BIGINT) AS capacity, (SELECT count(DISTINCT doc_id) FROM documents) AS documents,
  CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS needless_splits, CAST(0 AS BIGINT) AS broken FROM container_t WHERE capacity_tokens > 0""",
    "p8_checks": """SELECT lower(trim(source, ' ' || chr(9) || chr(160))) AS source, max(max_repeats) AS max_repeats, false AS over_cap, CAST(0 AS BIGINT) AS foreign_rows, false AS off_share
FROM mix_target_t WHERE source IS NOT NULL GROUP BY 1""",
    "p5_top_followers": _TOP + "SELECT prefix, follower, rank, occurences, factor FROM ranked WHERE rank <= 3",
}
