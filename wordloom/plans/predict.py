"""Queries that suggest next words and measure how good the suggestions are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import sortedarrays as sa
from wordloom.operators import cooccur, corpus, dictionary, evaluate, suggest
from wordloom.plans import model as m
from wordloom.plans import text as t
from wordloom.plans.text import QUERIES as TEXT
from wordloom.sources.tables import table
from wordloom.storage import materialize, release

K, K_APP = 3, 4


def _model(spark: SparkSession, d: str) -> suggest.Model:
    return suggest.Model(**m.pruned(spark, d, write=True))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return m.sentences(spark, d).where(F.size("words") > 0).groupBy("sent_id").agg(F.max("words").alias("words"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select(F.col("sent_id").alias("line"), F.col("words").alias("ids"))


def boundaries(spark: SparkSession, d: str, first: int = 0) -> DataFrame:
    """Every word of every sentence from position ``first`` on, the word that is to be suggested there: line, pos, target."""
    return _lines(spark, d).select("line", F.posexplode("ids").alias("pos", "target")).where(F.col("pos") >= first)


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence as a question whose answer is its last word: ctx_id, ids, target."""
    s = _sentences(spark, d)
    n = F.size("words")
    return s.select(F.col("sent_id").alias("ctx_id"), F.slice("words", 1, n - 1).alias("ids"), F.element_at("words", -1).alias("target"))


def _named(made: DataFrame) -> DataFrame:
    return made.withColumn("ctx_id", F.concat_ws("/", "line", "pos")).drop("line", "pos")


def _suggested(spark: SparkSession, d: str, k: int, hint: str = "", **variant) -> DataFrame:
    """Suggestions at every word boundary of every sentence, its start included."""
    asked = boundaries(spark, d).select("line", "pos", F.lit(hint).alias("hint"))
    return _named(suggest.suggest_lines(_lines(spark, d), asked, _model(spark, d), k, **variant))


def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The longest stored prefix before every word."""
    at = boundaries(spark, d).join(_lines(spark, d), "line")
    rows = at.select(F.concat_ws("/", "line", "pos").alias("ctx_id"), F.slice("ids", F.lit(1), F.col("pos")).alias("ids"))
    return suggest.longest_prefix(rows, _model(spark, d)).select("ctx_id", "prefix", "length")


def suggest_ngram(spark: SparkSession, d: str) -> DataFrame:
    """The ten best followers of the longest prefix with their expected value."""
    return _suggested(spark, d, 10).where("tier = 1").select("ctx_id", "rank", "id", "score")


def suggest_bayes(spark: SparkSession, d: str) -> DataFrame:
    """All that the words of a sentence but the last say of other words."""
    return suggest.bayes_products(contexts(spark, d), _model(spark, d)).select("ctx_id", "candidate", F.col("product").alias("score"))


def suggest_topk(spark: SparkSession, d: str) -> DataFrame:
    """Three suggestions before every word, in the batch variant."""
    return _suggested(spark, d, K).drop("hint")


def suggest_app(spark: SparkSession, d: str) -> DataFrame:
    """Four suggestions, in the interactive variant: no odds of the word itself, words of the context allowed."""
    return _suggested(spark, d, K_APP, with_odds=False, skip_context=False).drop("hint")


def suggest_hinted(spark: SparkSession, d: str) -> DataFrame:
    """Three suggestions that start with an s."""
    return _suggested(spark, d, K, "s")


def hit_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Hits by rank at all word boundaries, from the second word of a sentence on."""
    asked = materialize(boundaries(spark, d, 1), "boundaries")
    made = suggest.suggest_lines(_lines(spark, d), asked.select("line", "pos", F.lit("").alias("hint")), _model(spark, d), 5, wanted=asked.withColumnRenamed("target", "id"))
    return evaluate.hit_histogram(made, asked, evaluate.PLACE)


def _strokes(spark: SparkSession, d: str) -> DataFrame:
    # Spelled from the unpruned words: a target outside the dictionary is never suggested and costs its length.
    spelled = m.stored(spark, d)["words"].groupBy(F.col("id").alias("target")).agg(F.max("word").alias("word"))
    mod, named = _model(spark, d), boundaries(spark, d).join(spelled, "target", "left")
    return evaluate.line_keystrokes(_lines(spark, d), materialize(named, "targets"), mod, K)


def keystrokes(spark: SparkSession, d: str) -> DataFrame:
    """Keystrokes per word boundary; null where the next word has no spelling."""
    return _named(_strokes(spark, d))


def success_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of words found at the first guess, and characters per keystroke (of the words that have a spelling)."""
    return _strokes(spark, d).agg(
        F.count(F.lit(1)).alias("words"), F.count_if("first_guess").alias("found"), F.sum("strokes").alias("strokes"), F.sum("length").alias("characters")
    )


def top_followers(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent followers of every string prefix."""
    n = materialize(TEXT["ngram_counts_n"](spark, d), "ngrams")
    return dictionary.top_followers(n).withColumn("suggestions", F.array_join("suggestions", " "))


def _dictionary(spark: SparkSession, d: str, capacity: int = dictionary.N_MAX) -> DataFrame:
    n = materialize(TEXT["ngram_counts_n"](spark, d), "ngrams")
    large = [r["follower"] for r in n.where("n = 1").groupBy("follower").agg(F.sum("occurences").alias("c")).orderBy(F.desc("c"), "follower").limit(dictionary.N_SUG).collect()]
    return materialize(dictionary.suggestion_dictionary(materialize(dictionary.top_followers(n), "lists"), large, capacity), "dictionary")


def suggestion_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes with their suggestion lists and values; the capacity is the production parameter."""
    return _dictionary(spark, d)


#: A capacity below the number of prefixes even of a small collection, so that some are evicted.
SMALL = 1000


def dictionary_evicted(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary with room for a thousand prefixes; the others leave their value to shorter ones."""
    return _dictionary(spark, d, SMALL)


def dictionary_stats(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.dictionary_stats(_dictionary(spark, d))


def dict_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The stored suggestions for every masked sentence."""
    rows = t.mask_rare(spark, d).select(F.concat_ws("/", "doc_id", "line_no", "sent_no").alias("ctx_id"), F.split("sentence", " ").alias("words"))
    return dictionary.lookup(rows, _dictionary(spark, d))


def ml_probability(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.ml_probabilities(TEXT["ngram_counts_n"](spark, d))


def continuation_counts(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.continuation_counts(TEXT["ngram_counts_n"](spark, d))


def kneser_ney(spark: SparkSession, d: str) -> DataFrame:
    n = materialize(TEXT["ngram_counts_n"](spark, d), "ngrams")
    return dictionary.kneser_ney(n).withColumn("p", F.round("p", 9))


def _combined(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from wordloom.operators.ngrams import fixed_ngrams

    s = materialize(m.sentences(spark, d), "sentences")
    rows = s.select(m.path_text("words").alias("sentence"))
    grams = None
    for n in range(1, 5):
        one = fixed_ngrams(rows, n)
        grams = one if grams is None else grams.unionByName(one)
    p = materialize(dictionary.ml_probabilities(grams).withColumn("follower", F.col("follower").cast("bigint")), "probabilities")
    asked = materialize(contexts(spark, d), "contexts")
    release(s)
    multi = materialize(m.pair_counts_multiset(spark, d), "multiset-pairs")
    # Of all pairs, only those of a context's words with followers offered to it need a factor.
    scores = dictionary.combined_scores(asked.select("ctx_id", F.col("ids").alias("words")), p, lambda pairs: materialize(cooccur.row_sum_factors(multi, pairs), "rowsum"))
    scores = materialize(scores, "scores")
    release(p, multi)
    return scores, asked


def combined_score(spark: SparkSession, d: str) -> DataFrame:
    return _combined(spark, d)[0]


def multiple_choice(spark: SparkSession, d: str) -> DataFrame:
    """For every context the true word and three decoys (the words of the next, second and third id): place and score."""
    scores, asked = _combined(spark, d)
    choices = asked.select("ctx_id", F.explode(F.array(*[F.col("target") + k for k in range(4)])).alias("follower"))
    return dictionary.score_choices(scores, choices)


def split_input(spark: SparkSession, d: str) -> DataFrame:
    """Each line as typed so far: the finished part and the word at its end."""
    rows = corpus.lines(table(spark, d, "documents").select("doc_id", "text"))
    return suggest.split_input(rows, "line").select("doc_id", "line_no", "finished", "hint")


def accept_suggestion(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.lines(table(spark, d, "documents").select("doc_id", "text"))
    return suggest.accept(rows.withColumn("w", F.lit("word")), "line", "w").select("doc_id", "line_no", "accepted")


def sorted_list(spark: SparkSession, d: str) -> DataFrame:
    """The sorted-list operations on the sorted words of every sentence."""
    s = m.sentences(spark, d).select("sent_id", F.array_sort("words").alias("a")).where(F.size("a") > 0)
    x = F.element_at("a", 1)
    text = m.path_text
    return s.select(
        "sent_id", text(sa.add(F.col("a"), 100)).alias("added"), text(sa.discard(F.col("a"), x)).alias("discarded"), sa.bisect_left(F.col("a"), 100).alias("left_of"),
        sa.bisect_right(F.col("a"), 100).alias("right_of"), sa.count(F.col("a"), x).alias("counted"), sa.index(F.col("a"), F.element_at("a", -1)).alias("found_at"),
        sa.getitem(F.col("a"), -1).alias("last"), text(sa.pop(F.col("a"))).alias("popped"), text(sa.islice(F.col("a"), 1, 3)).alias("part"),
        text(sa.irange(F.col("a"), 10, 1000)).alias("ranged"), text(sa.backwards(F.col("a"))).alias("reversed"), text(sa.repeat(F.col("a"), 2)).alias("doubled"),
        text(sa.update(F.col("a"), F.array(x + 1))).alias("updated"), text(sa.sort_by_key(F.col("a"), lambda v: -v)).alias("by_key"), text(sa.setitem(F.col("a"), 0, -1)).alias("replaced"),
        text(sa.insert(F.col("a"), 1, 50)).alias("inserted"), text(sa.extend(F.col("a"), F.array(F.lit(5000).cast("bigint")))).alias("extended"),
        sa.compare(F.col("a"), F.array(x, x)).alias("compared"), sa.bisect_key_left(F.col("a"), 7, lambda v: v % 10).alias("key_left"),
        sa.bisect_key_right(F.col("a"), 7, lambda v: v % 10).alias("key_right"), text(sa.irange_key(F.col("a"), 2, 7, lambda v: v % 10, (True, False))).alias("key_ranged"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        longest_prefix, suggest_ngram, suggest_bayes, suggest_topk, suggest_app, suggest_hinted, hit_histogram, keystrokes, success_ratio, top_followers, suggestion_dictionary, dictionary_evicted,
        dictionary_stats, dict_lookup, ml_probability, continuation_counts, kneser_ney, combined_score, multiple_choice, split_input, accept_suggestion, sorted_list,
    )
}

_CONTEXTS = """,
c0 AS (SELECT sent_id, max(w) AS w FROM s WHERE len(w) > 0 GROUP BY 1),
ctx AS (SELECT sent_id AS ctx_id, w[1:len(w) - 1] AS ids, w[-1] AS target FROM c0)"""
_BOUNDARIES = """,
c0 AS (SELECT sent_id, max(w) AS w FROM s WHERE len(w) > 0 GROUP BY 1),
ctx AS (SELECT concat_ws('/', sent_id, i) AS ctx_id, w[1:i] AS ids, w[i + 1] AS target FROM (SELECT sent_id, w, unnest(range(%d, len(w))) AS i FROM c0))"""
_ASKED = "asked AS (SELECT ctx_id, {} AS hint FROM ctx)"
_TYPED = """spelled AS (SELECT id AS target, max(word) AS word FROM w0 GROUP BY 1),
truth AS (SELECT ctx_id, target, word FROM ctx LEFT JOIN spelled USING (target)),
asked AS (SELECT ctx_id, substr(word, 1, h) AS hint FROM (SELECT ctx_id, word, unnest(range(greatest(length(word), 1))) AS h FROM truth WHERE word IS NOT NULL))"""


def _candidates(odds: bool = True, skip: bool = True, places: str = _BOUNDARIES % 0) -> str:
    start = "o.odds * " if odds else ""
    return f"""WITH {m.SENTENCES}, {m.CLEAN}{places},
total AS (SELECT CAST(sum(occurences) AS DOUBLE) AS t FROM w1),
odds AS (SELECT id, occurences / nullif((SELECT t FROM total) - occurences, 0) AS odds FROM w1),
pos AS (SELECT ctx_id, ids, unnest(ids) AS condition, unnest(range(len(ids))) AS pos FROM ctx),
hit AS (SELECT ctx_id, conditional AS candidate, list(factor ORDER BY pos) AS f FROM pos JOIN b1 USING (condition) {"WHERE NOT list_contains(ids, conditional)" if skip else ""} GROUP BY 1, 2),
prod AS (SELECT ctx_id, candidate, list_reduce(list_prepend({"o.odds" if odds else "1.0::DOUBLE"}, f), lambda x, y: x * y) AS product FROM hit {"JOIN odds o ON o.id = candidate WHERE o.odds IS NOT NULL" if odds else ""}),
x1 AS (SELECT ctx_id, id FROM ctx JOIN p3 ON parent = -1 AND word = ids[-1]),
x2 AS (SELECT ctx_id, p3.id FROM x1 JOIN ctx USING (ctx_id) JOIN p3 ON parent = x1.id AND word = ids[-2]),
x3 AS (SELECT ctx_id, p3.id FROM x2 JOIN ctx USING (ctx_id) JOIN p3 ON parent = x2.id AND word = ids[-3]),
x4 AS (SELECT ctx_id, p3.id FROM x3 JOIN ctx USING (ctx_id) JOIN p3 ON parent = x3.id AND word = ids[-4]),
lp AS (SELECT ctx_id, coalesce(x4.id, x3.id, x2.id, x1.id, -1) AS prefix,
  CAST((x1.id IS NOT NULL)::INT + (x2.id IS NOT NULL)::INT + (x3.id IS NOT NULL)::INT + (x4.id IS NOT NULL)::INT AS BIGINT) AS length
  FROM ctx LEFT JOIN x1 USING (ctx_id) LEFT JOIN x2 USING (ctx_id) LEFT JOIN x3 USING (ctx_id) LEFT JOIN x4 USING (ctx_id)),
fol AS (SELECT ctx_id, follower AS candidate, occurences, factor FROM lp JOIN n2 USING (prefix)),
cand AS (SELECT coalesce(fol.ctx_id, prod.ctx_id) AS ctx_id, coalesce(fol.candidate, prod.candidate) AS candidate, CASE WHEN fol.ctx_id IS NULL THEN 2 ELSE 1 END AS tier,
  CASE WHEN fol.ctx_id IS NULL THEN product ELSE occurences * (coalesce(factor, 1e100) * coalesce(product, 1)) / (1 + coalesce(factor, 1e100) * coalesce(product, 1)) END AS score
  FROM fol FULL JOIN prod ON fol.ctx_id = prod.ctx_id AND fol.candidate = prod.candidate)"""


def _suggest(k: int, asked: str = _ASKED.format("''"), odds: bool = True, skip: bool = True, first: int = 0) -> str:
    return (
        _candidates(odds, skip, _BOUNDARIES % first)
        + f""",
{asked},
named AS (SELECT ctx_id, hint, candidate, tier, score, word FROM cand JOIN w1 ON w1.id = candidate JOIN asked USING (ctx_id) WHERE word IS NOT NULL AND starts_with(word, hint) AND NOT isnan(score)),
first AS (SELECT *, row_number() OVER (PARTITION BY ctx_id, hint ORDER BY tier, score DESC, candidate) AS rank FROM named QUALIFY rank <= {k}),
had AS (SELECT ctx_id, hint, max(rank) AS had, list(candidate) AS taken FROM first GROUP BY 1, 2),
begun AS (SELECT id, word, occurences, substr(word, 1, unnest(range(length(word) + 1))) AS hint FROM w1 WHERE word IS NOT NULL),
large AS (SELECT hint, id, word, occurences, row_number() OVER (PARTITION BY hint ORDER BY occurences DESC NULLS LAST, id) AS place FROM begun JOIN (SELECT DISTINCT hint FROM asked) USING (hint) QUALIFY place <= {2 * k - 1}),
fill AS (SELECT asked.ctx_id, asked.hint, large.id AS candidate, word, occurences, coalesce(had, 0) + row_number() OVER (PARTITION BY asked.ctx_id, asked.hint ORDER BY place) AS rank
  FROM asked LEFT JOIN had USING (ctx_id, hint) JOIN large ON large.hint = asked.hint WHERE coalesce(had, 0) < {k} AND (taken IS NULL OR NOT list_contains(taken, large.id)) QUALIFY rank <= {k}),
made AS (SELECT ctx_id, hint, rank, candidate AS id, word, CAST(tier AS BIGINT) AS tier, score FROM first UNION ALL SELECT ctx_id, hint, rank, candidate, word, 3, CAST(occurences AS DOUBLE) FROM fill)
"""
    )


_STROKES = (
    _suggest(K, _TYPED)
    + """, reached AS (SELECT ctx_id, min(length(made.hint)) AS typed FROM made JOIN truth USING (ctx_id) WHERE made.id = target GROUP BY 1),
strokes AS (SELECT ctx_id, CAST(coalesce(typed + 1, length(word)) AS BIGINT) AS strokes, coalesce(typed = 0, false) AS first_guess, CAST(length(word) AS BIGINT) AS length FROM truth LEFT JOIN reached USING (ctx_id))
"""
)


_GRAMS = t.SQL["ngram_counts_n"].rsplit("SELECT n,", 1)
_GRAMS = _GRAMS[0] + ", g AS (SELECT n," + _GRAMS[1] + ")"
_GRAMS = _GRAMS.replace("<> 1)\n, g", "<> 1), g")
_KN = "".join(
    f""",
l{n} AS (SELECT *, sum(occurences) OVER p AS cu, count(*) OVER p AS t FROM g WHERE n = {n} WINDOW p AS (PARTITION BY prefix)),
d{n} AS (SELECT l.*, CAST(floor(CAST(cu AS DOUBLE) / t / 2) AS BIGINT) AS d, coalesce(k.p, 0) / c.prefixes AS weight FROM l{n} l
  LEFT JOIN kn{n - 1} k ON k.prefix = substr(l.prefix, instr(l.prefix, ' ') + 1) AND k.follower = l.follower JOIN cont c ON c.n = {n} AND c.follower = l.follower),
s{n} AS (SELECT *, sum(least(occurences, d)) OVER p AS borrowed, sum(weight) OVER p AS total FROM d{n} WINDOW p AS (PARTITION BY prefix)),
kn{n} AS (SELECT n, prefix, follower, greatest(occurences - d, 0) / CAST(cu AS DOUBLE) + (CASE WHEN total > 0 THEN borrowed / CAST(cu AS DOUBLE) / total ELSE 0 END) * weight AS p FROM s{n})"""
    for n in (2, 3, 4)
)
_RS = m.SQL["bayes_factors_rowsum"].replace("\nSELECT condition, conditional, occurences, (occurences", ", rs AS (SELECT condition, conditional, (occurences") + ")"
_COMBINED = (
    _RS.replace("JOIN c j ON j.id = conditional)", "JOIN c j ON j.id = conditional)")
    + _CONTEXTS
    + """,
spots AS (SELECT n, w, unnest(range(1, len(w) - n + 1)) AS i FROM s, (VALUES (CAST(1 AS BIGINT)), (2), (3), (4)) AS v(n) WHERE len(w) > n),
g AS (SELECT n, w[i:i + n - 1] AS prefix, w[i + n] AS follower, count(*) AS occurences FROM spots GROUP BY 1, 2, 3),
ml AS (SELECT n, prefix, follower, occurences / CAST(sum(occurences) OVER (PARTITION BY n, prefix) AS DOUBLE) AS p FROM g),
ends AS (SELECT ctx_id, ids, n, ids[len(ids) - n + 1:len(ids)] AS prefix FROM ctx, (VALUES (CAST(1 AS BIGINT)), (2), (3), (4)) AS v(n) WHERE n <= len(ids)),
best AS (SELECT e.* FROM ends e WHERE EXISTS (SELECT 1 FROM g WHERE g.n = e.n AND g.prefix = e.prefix) QUALIFY row_number() OVER (PARTITION BY ctx_id ORDER BY n DESC) = 1),
offered AS (SELECT ctx_id, ids, follower, p FROM best JOIN ml USING (n, prefix)),
pos AS (SELECT ctx_id, follower, unnest(ids) AS condition, unnest(range(len(ids))) AS pos FROM offered),
odds AS (SELECT ctx_id, follower, list_reduce(list_prepend(1.0::DOUBLE, list(factor ORDER BY pos)), lambda x, y: x * y) AS odds
  FROM pos JOIN rs ON rs.condition = pos.condition AND rs.conditional = follower WHERE factor IS NOT NULL GROUP BY 1, 2),
scores AS (SELECT o.ctx_id, o.follower, CASE WHEN odds IS NULL THEN p ELSE p * odds / (1 + odds) END AS score FROM offered o LEFT JOIN odds USING (ctx_id, follower))
"""
)
_LINES = "WITH lines AS (SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))"

_IDS = "array_to_string({}, ' ')"
SQL: dict[str, str] = {
    "longest_prefix": _candidates() + " SELECT ctx_id, prefix, length FROM lp",
    "suggest_ngram": _suggest(10) + " SELECT ctx_id, rank, id, score FROM made WHERE tier = 1",
    "suggest_bayes": _candidates(places=_CONTEXTS) + " SELECT ctx_id, candidate, product AS score FROM prod",
    "suggest_topk": _suggest(K) + " SELECT ctx_id, rank, id, word, tier, score FROM made",
    "suggest_app": _suggest(K_APP, odds=False, skip=False) + " SELECT ctx_id, rank, id, word, tier, score FROM made",
    "suggest_hinted": _suggest(K, _ASKED.format("'s'")) + " SELECT ctx_id, hint, rank, id, word, tier, score FROM made",
    "hit_histogram": _suggest(5, first=1)
    + """, hits AS (SELECT ctx_id, min(rank) AS rank FROM made JOIN ctx USING (ctx_id) WHERE made.id = target GROUP BY 1)
SELECT coalesce(rank, 0) AS tries, count(*) AS "count" FROM ctx LEFT JOIN hits USING (ctx_id) GROUP BY 1""",
    "keystrokes": _STROKES + " SELECT * FROM strokes",
    "success_ratio": _STROKES
    + """ SELECT count(*) AS words, count(*) FILTER (first_guess) AS found, CAST(sum(strokes) AS BIGINT) AS strokes, CAST(sum(length) AS BIGINT) AS characters FROM strokes""",
    "top_followers": _GRAMS
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY occurences DESC, follower) AS rank FROM g)
SELECT prefix, CAST(sum(occurences) AS BIGINT) AS total, string_agg(follower, ' ' ORDER BY rank) FILTER (rank <= 5) AS suggestions FROM ranked GROUP BY prefix""",
    "ml_probability": _GRAMS + " SELECT n, prefix, follower, occurences / CAST(sum(occurences) OVER (PARTITION BY n, prefix) AS DOUBLE) AS p FROM g",
    "continuation_counts": _GRAMS + " SELECT n, follower, count(*) AS prefixes FROM g GROUP BY 1, 2",
    "kneser_ney": _GRAMS
    + """, cont AS (SELECT n, follower, count(*) AS prefixes FROM g GROUP BY 1, 2),
kn1 AS (SELECT n, prefix, follower, occurences / CAST(sum(occurences) OVER (PARTITION BY prefix) AS DOUBLE) AS p FROM g WHERE n = 1)"""
    + _KN
    + " SELECT n, prefix, follower, round(p, 9) AS p FROM (SELECT * FROM kn1 UNION ALL SELECT * FROM kn2 UNION ALL SELECT * FROM kn3 UNION ALL SELECT * FROM kn4)",
    "combined_score": _COMBINED + f"SELECT ctx_id, follower, score FROM scores",
    "multiple_choice": _COMBINED
    + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY score DESC, follower DESC) AS place FROM scores WHERE score > 0),
choices AS (SELECT ctx_id, target + unnest([0, 1, 2, 3]) AS follower FROM ctx)
SELECT ctx_id, follower, score, place FROM choices LEFT JOIN placed USING (ctx_id, follower)""",
    "split_input": _LINES + " SELECT doc_id, line_no, regexp_extract(line, '^([\\s\\S]*?)([^\\s]*)\\z', 1) AS finished, regexp_extract(line, '^([\\s\\S]*?)([^\\s]*)\\z', 2) AS hint FROM lines",
    "accept_suggestion": _LINES + " SELECT doc_id, line_no, concat_ws(' ', nullif(trim(regexp_replace(line, '[^\\s]*\\z', ''), ' '), ''), 'word') || ' ' AS accepted FROM lines",
    "sorted_list": f"""WITH {m.SENTENCES}, z AS (SELECT sent_id, list_sort(w) AS a FROM s WHERE len(w) > 0)
SELECT sent_id, {_IDS.format("list_sort(list_append(a, 100))")} AS added, {_IDS.format("a[2:]")} AS discarded,
CAST(len([x FOR x IN a IF x < 100]) AS BIGINT) AS left_of, CAST(len([x FOR x IN a IF x <= 100]) AS BIGINT) AS right_of, CAST(len([x FOR x IN a IF x = a[1]]) AS BIGINT) AS counted,
CAST(list_position(a, a[-1]) - 1 AS BIGINT) AS found_at, a[-1] AS last, {_IDS.format("a[:len(a) - 1]")} AS popped, {_IDS.format("a[2:3]")} AS part,
{_IDS.format("[x FOR x IN a IF x >= 10 AND x <= 1000]")} AS ranged, {_IDS.format("list_reverse(a)")} AS reversed, {_IDS.format("list_sort(list_concat(a, a))")} AS doubled,
{_IDS.format("list_sort(list_append(a, a[1] + 1))")} AS updated, {_IDS.format("list_reverse(a)")} AS by_key,
CASE WHEN len(a) = 1 OR a[2] >= -1 THEN {_IDS.format("list_concat([-1], a[2:])")} END AS replaced,
CASE WHEN a[1] <= 50 AND (len(a) = 1 OR a[2] >= 50) THEN {_IDS.format("list_concat(a[1:1], [50], a[2:])")} END AS inserted,
CASE WHEN a[-1] <= 5000 THEN {_IDS.format("list_append(a, 5000)")} END AS extended, CAST(CASE WHEN a < [a[1], a[1]] THEN -1 WHEN a = [a[1], a[1]] THEN 0 ELSE 1 END AS BIGINT) AS compared,
CAST(len([x FOR x IN a IF x % 10 < 7]) AS BIGINT) AS key_left, CAST(len([x FOR x IN a IF x % 10 <= 7]) AS BIGINT) AS key_right,
{_IDS.format("[y.v FOR y IN list_sort([{'k': x % 10, 'v': x} FOR x IN a IF x % 10 >= 2 AND x % 10 < 7])]")} AS key_ranged FROM z""",
}
