"""Queries over the documents' texts: normalising, counting, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.stem import stem_column
from wordloom.functions.textrules import normalise, subsentences
from wordloom.operators import corpus, ngrams
from wordloom.plans import sqltext
from wordloom.session import spread
from wordloom.sources.tables import table
from wordloom.storage import materialize

COVERED, TRAIN = 0.9, 0.8


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "source", "lang"))


def _sentences(spark: SparkSession, d: str, rules: str) -> DataFrame:
    """Normalised once and written: counting and encoding both read it."""
    return materialize(corpus.sentences(_documents(spark, d).select("doc_id", "text"), rules), f"sentences-{rules}")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.corpus_stats(corpus.lines(_documents(spark, d), keep=["lang", "source"]), ["lang", "source"])


def _normal(rules: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = corpus.sentences(_documents(spark, d).select("doc_id", "text"), rules)
        return s.withColumn("sent_no", F.lit(0) if "sent_no" not in s.columns else F.col("sent_no")).select("doc_id", "line_no", F.col("sent_no").cast("bigint").alias("sent_no"), "sentence")

    return run


def subsentence_split(spark: SparkSession, d: str) -> DataFrame:
    rows = subsentences(corpus.lines(_documents(spark, d).select("doc_id", "text")), "line", "part_no")
    return rows.select("doc_id", "line_no", F.col("part_no").cast("bigint").alias("part_no"), F.col("line").alias("part"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.word_counts(corpus.sentences(_documents(spark, d).select("doc_id", "text")))


def word_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return corpus.dictionary(word_counts(spark, d))


def coverage_curve(spark: SparkSession, d: str) -> DataFrame:
    return corpus.coverage(materialize(word_counts(spark, d), "word-counts"))


def top_words(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen most frequent words."""
    return word_counts(spark, d).orderBy(F.desc("occurences"), "word").limit(15)


def frequent_words(spark: SparkSession, d: str) -> DataFrame:
    """Words whose running count stays strictly below nine tenths of all tokens."""
    return coverage_curve(spark, d).where(F.col("coverage") < COVERED).select("idx", "word", "occurences")


def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per source (trimmed, lower case) the words by rank with their running share of its tokens."""
    docs = _documents(spark, d).select("text", F.lower(F.trim("source")).alias("src")).where("src is not null")
    n = normalise(docs.select("src", F.explode(F.split("text", "\n")).alias("line")), "line")
    n = n.select("src", F.explode(F.split("line", " ")).alias("word")).groupBy("src", "word").agg(F.count(F.lit(1)).alias("occurences"))
    n = materialize(n, "source-words")
    total = n.groupBy("src").agg(F.sum("occurences").alias("total"))
    # One sorted scan over all sources; a source's own rank and sum come from where it starts.
    scan = materialize(corpus.ordered_scan(n, [F.asc("src"), F.desc("occurences"), F.asc("word")], "occurences"), "source-scan")
    start = scan.groupBy("src").agg(F.min("row_no").alias("first"), F.min(F.col("running") - F.col("occurences")).alias("base"))
    both = scan.join(F.broadcast(start.join(total, "src")), "src")
    return both.select("src", (F.col("row_no") - F.col("first") + 1).alias("idx"), "word", "occurences", ((F.col("running") - F.col("base")) / F.col("total")).alias("coverage"))


def encode_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d, "final")
    words = corpus.dictionary(corpus.word_counts(s))
    encoded = corpus.encode(corpus.tokens(s), words, ["doc_id", "line_no"])
    return encoded.select("doc_id", "line_no", F.array_join(F.transform("words", lambda x: x.cast("string")), " ").alias("ids"))


def _masked(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d, "common")
    common = corpus.coverage(materialize(corpus.word_counts(s), "common-counts")).where(F.col("coverage") <= COVERED)
    return corpus.mask_rare(corpus.tokens(s), common, ["doc_id", "line_no", "sent_no"])


def mask_rare(spark: SparkSession, d: str) -> DataFrame:
    return _masked(spark, d).withColumn("sent_no", F.col("sent_no").cast("bigint"))


def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.lines(_documents(spark, d).select("doc_id", "text")).select("doc_id", "line_no")
    return corpus.train_test(rows, ["doc_id", "line_no"], TRAIN)


def string_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Two- and three-word sequences of the sub-sentences, with their counts."""
    parts = subsentence_split(spark, d).select(F.trim(F.lower("part")).alias("sentence")).where("sentence <> ''")
    return corpus.string_ngrams(parts, 2, 3).withColumn("n", F.col("n").cast("bigint"))


def ngram_counts_n(spark: SparkSession, d: str) -> DataFrame:
    """String prefixes of one to four words with their followers, over masked sentences."""
    s = materialize(_masked(spark, d).select("sentence"), "masked")
    out = None
    for n in range(1, 5):
        one = ngrams.fixed_ngrams(s, n)
        out = one if out is None else out.unionByName(one)
    return out


def stem_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by English stem; spellings are counted first, so that each is stemmed once."""
    parts = subsentence_split(spark, d).select(F.explode(F.split(F.regexp_replace(F.lower("part"), r"[^\p{L}\p{N}'\s]", " "), r"\s+")).alias("word")).where("word <> ''")
    words = parts.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select(stem_column(F.col("word")).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("occurences"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "corpus_stats": corpus_stats,
    "normalize_lines": _normal("final"),
    "normalize_app": _normal("app"),
    "normalize_plain": _normal("plain"),
    "normalize_commas": _normal("commas"),
    "normalize_common": _normal("common"),
    **{f.__name__: f for f in (subsentence_split, word_counts, word_dictionary, coverage_curve, top_words, frequent_words, source_coverage, encode_sentences, mask_rare)},
    **{f.__name__: f for f in (train_test_split, string_ngrams, ngram_counts_n, stem_counts)},
}

_COUNTS = "WITH " + sqltext.tokens("final") + ",\ncounts AS (SELECT word, count(*) AS occurences FROM tokens GROUP BY word)"
_WORDS = """,
one AS (SELECT lower(word) AS lw, max(word) AS word, CAST(sum(occurences) AS BIGINT) AS occurences FROM counts GROUP BY 1 HAVING sum(occurences) > 1),
words AS (SELECT row_number() OVER (ORDER BY lw) - 1 AS id, lw, word, occurences FROM one)
"""
_CURVE = """,
total AS (SELECT CAST(sum(occurences) AS DOUBLE) AS t FROM counts),
curve AS (SELECT row_number() OVER w AS idx, word, occurences, occurences / (SELECT t FROM total) AS termfreq,
  CAST(sum(occurences) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) / (SELECT t FROM total) AS coverage
  FROM counts WINDOW w AS (ORDER BY occurences DESC, word))
"""
_MASKED = (
    "WITH "
    + sqltext.tokens("common")
    + ",\ncounts AS (SELECT word, count(*) AS occurences FROM tokens GROUP BY word)"
    + _CURVE
    + """,
common AS (SELECT word FROM curve WHERE coverage <= 0.9),
marked AS (SELECT t.*, CASE WHEN c.word IS NULL THEN '_' ELSE t.word END AS shown FROM tokens t LEFT JOIN common c ON c.word = t.word),
masked AS (SELECT doc_id, line_no, sent_no, '^ ' || regexp_replace(string_agg(shown, ' ' ORDER BY pos), '_[ _]*_', '_', 'g') AS sentence FROM marked GROUP BY 1, 2, 3)
"""
)
_PLAIN = "SELECT doc_id, line_no, sent_no, sentence FROM sentences"


SQL: dict[str, str] = {
    "corpus_stats": f"""WITH {sqltext.LINES} SELECT lang, source, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars,
CAST(sum(len(regexp_extract_all(line, '\\S+'))) AS BIGINT) AS n_words, max(length(line)) AS max_line FROM lines GROUP BY 1, 2""",
    "normalize_lines": f"WITH {sqltext.sentences('final')} {_PLAIN}",
    "normalize_app": f"WITH {sqltext.sentences('app')} {_PLAIN}",
    "normalize_plain": f"WITH {sqltext.sentences('plain')} {_PLAIN}",
    "normalize_commas": f"WITH {sqltext.sentences('commas')} {_PLAIN}",
    "normalize_common": f"WITH {sqltext.sentences('common')} {_PLAIN}",
    "subsentence_split": f"WITH {sqltext.SUBSENTENCES} SELECT doc_id, line_no, part_no, part FROM subsentences",
    "word_counts": _COUNTS + " SELECT word, occurences FROM counts",
    "word_dictionary": _COUNTS + _WORDS + "SELECT id, word, occurences FROM words",
    "coverage_curve": _COUNTS + _CURVE + "SELECT idx, word, occurences, termfreq, coverage FROM curve",
    "top_words": _COUNTS + " SELECT word, occurences FROM counts ORDER BY occurences DESC, word LIMIT 15",
    "frequent_words": _COUNTS + _CURVE + "SELECT idx, word, occurences FROM curve WHERE coverage < 0.9",
    "source_coverage": f"""WITH {sqltext.tokens("final")},
counts AS (SELECT src, word, count(*) AS occurences FROM tokens t JOIN (SELECT doc_id, lower(trim(source, ' ')) AS src FROM documents) d ON d.doc_id = t.doc_id WHERE src IS NOT NULL GROUP BY 1, 2)
SELECT src, row_number() OVER w AS idx, word, occurences,
  CAST(sum(occurences) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) / CAST(sum(occurences) OVER (PARTITION BY src) AS DOUBLE) AS coverage
FROM counts WINDOW w AS (PARTITION BY src ORDER BY occurences DESC, word)""",
    "encode_sentences": _COUNTS
    + _WORDS
    + "SELECT doc_id, line_no, string_agg(CAST(w.id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM tokens t JOIN words w ON w.lw = lower(t.word) GROUP BY 1, 2",
    "mask_rare": _MASKED + "SELECT doc_id, line_no, sent_no, sentence FROM masked",
    "train_test_split": f"""WITH {sqltext.LINES},
a AS (SELECT doc_id, line_no, (CAST(1519531190 AS BIGINT) * 48271 + doc_id * 16807 + 12345) % 2147483647 AS m FROM lines),
b AS (SELECT doc_id, line_no, (m * 48271 + line_no * 16807 + 12345) % 2147483647 AS m FROM a)
SELECT doc_id, line_no, CASE WHEN (m // 7) % 1000 < 800 THEN 'train' ELSE 'test' END AS part FROM b""",
    "string_ngrams": f"""WITH {sqltext.SUBSENTENCES},
w AS (SELECT string_split(trim(lower(part), ' '), ' ') AS w FROM subsentences WHERE trim(part, ' ') <> ''),
g AS (SELECT n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS ngram FROM w, (VALUES (CAST(2 AS BIGINT)), (3)) AS v(n) WHERE len(w) >= n)
SELECT n, ngram, count(*) AS occurences FROM g GROUP BY 1, 2""",
    "ngram_counts_n": _MASKED
    + """, w AS (SELECT string_split(sentence, ' ') AS w FROM masked),
spots AS (SELECT n, w, unnest(range(1, len(w) - n + 1)) AS i FROM w, (VALUES (CAST(1 AS BIGINT)), (2), (3), (4)) AS v(n) WHERE len(w) > n)
SELECT n, array_to_string(w[i:i + n - 1], ' ') AS prefix, w[i + n] AS follower, count(*) AS occurences FROM spots
WHERE w[i + n] NOT IN ('_', ',') GROUP BY 1, 2, 3""",
}
