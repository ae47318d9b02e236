"""From texts to encoded sentences: lines, tokens, dictionary, coverage, encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.textrules import normalise
from wordloom.storage import materialize


def lines(documents: DataFrame, id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per line of each text: ``id``, line_no from 0, line, and the columns ``keep``.

    Lines end at ``\\n`` only.  A null text has no lines, an empty one has one empty line.
    """
    return documents.select(id, *keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


def sentences(documents: DataFrame, rules: str = "final") -> DataFrame:
    """Normalised sentences: doc_id, line_no, (sent_no,) sentence."""
    rows = normalise(lines(documents), "line", rules, number="sent_no")
    return rows.withColumnRenamed("line", "sentence")


def tokens(rows: DataFrame, sentence: str = "sentence") -> DataFrame:
    """One row per token: the other columns, pos from 0 and word."""
    others = [c for c in rows.columns if c != sentence]
    return rows.select(*others, F.posexplode(F.split(sentence, " ")).alias("pos", "word")).where("word <> ''")


def word_counts(rows: DataFrame, sentence: str = "sentence", ignore: Sequence[str] = ()) -> DataFrame:
    """Occurrences of each spelling as it stands: word, occurences."""
    words = rows.select(F.explode(F.split(sentence, " ")).alias("word")).where(F.col("word") != "")
    return words.where(~F.col("word").isin(list(ignore))).groupBy("word").agg(F.count(F.lit(1)).alias("occurences"))


def corpus_stats(rows: DataFrame, by: Sequence[str], line: str = "line") -> DataFrame:
    """Lines, characters, words and the longest line per group."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length(line)).alias("n_chars"),
        F.sum(F.regexp_count(line, F.lit(r"\S+"))).cast("bigint").alias("n_words"), F.max(F.length(line)).cast("bigint").alias("max_line"),
    )


def ordered_scan(df: DataFrame, order: Sequence[Column], value: str | None = None) -> DataFrame:
    """Add ``row_no`` (from 0, in ``order``) and, with ``value``, ``running``: its sum up to and with the row.

    The rows are sorted by range into a written table; only the tasks' counts and
    sums, one row per task, are added up in one place.
    """
    at = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    at = at.withColumn("_task", F.shiftright("_at", 33))
    v = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(0)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = at.groupBy("_task").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"))
    tasks = tasks.select("_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_s"))
    within = Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = at.withColumn("_running", F.sum(v).over(within)) if value else at
    out = out.join(F.broadcast(tasks), "_task").withColumn("row_no", F.col("_n") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    if value:
        out = out.withColumn("running", F.col("_s") + F.col("_running"))
    return out.drop("_at", "_task", "_n", "_s", "_running")


def dictionary(counts: DataFrame, min_count: int = 2) -> DataFrame:
    """Dense ids over the words in order of their lower-case form: id from 0, word, occurences.

    Spellings that differ in case become one word: the one last in code-point order,
    so that lower case wins.  Words seen less than ``min_count`` times get no id.
    """
    one = counts.groupBy(F.lower("word").alias("lower")).agg(F.max("word").alias("word"), F.sum("occurences").alias("occurences"))
    ranked = ordered_scan(one.where(F.col("occurences") >= min_count), [F.col("lower")])
    return ranked.select(F.col("row_no").alias("id"), "word", "occurences")


def coverage(counts: DataFrame) -> DataFrame:
    """Per word in descending count (equals by word): idx from 1, termfreq and running coverage of all tokens."""
    total = counts.agg(F.sum("occurences")).first()[0] or 1
    scan = ordered_scan(counts, [F.desc("occurences"), F.asc("word")], "occurences")
    return scan.select(
        (F.col("row_no") + 1).alias("idx"), "word", "occurences", (F.col("occurences") / F.lit(float(total))).alias("termfreq"),
        (F.col("running") / F.lit(float(total))).alias("coverage"),
    )


def encode(token_rows: DataFrame, words: DataFrame, key: Sequence[str]) -> DataFrame:
    """Sentences as word ids in order of position; unknown words are dropped, so neighbours close up.

    A sentence without any known word gives no row.
    """
    ids = words.select(F.lower("word").alias("lower"), "id")
    found = token_rows.withColumn("lower", F.lower("word")).join(ids, "lower")
    listed = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("w"))
    return listed.select(*key, F.transform("w", lambda x: x["id"]).alias("words"))


UNKNOWN, START = "_", "^"


def mask_rare(token_rows: DataFrame, common: DataFrame, key: Sequence[str]) -> DataFrame:
    """Sentences in which words outside ``common`` are ``_`` (runs of them one), begun with ``^``."""
    known = common.select("word", F.lit(True).alias("known"))
    marked = token_rows.join(known, "word", "left").withColumn("word", F.when(F.col("known"), F.col("word")).otherwise(UNKNOWN))
    listed = marked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["word"]), " ")
    return listed.select(*key, F.concat(F.lit(START + " "), F.regexp_replace(text, "_[ _]*_", "_")).alias("sentence"))


def collapse_unknowns(words: Column) -> Column:
    """The same on an array of words: of neighbouring ``_`` only the first stays."""
    before = lambda i: F.try_element_at(words, F.greatest(i, F.lit(1)).cast("int"))
    return F.filter(words, lambda w, i: ~((w == UNKNOWN) & (i > 0) & (before(i) == UNKNOWN)))


def split_bucket(*keys: Column) -> Column:
    """A number from 0 to 999 from integer keys, the same on every engine."""
    mixed = F.lit(1519531190).cast("bigint")
    for k in keys:
        mixed = F.pmod(mixed * 48271 + k * 16807 + 12345, F.lit(2147483647))
    return F.pmod(F.floor(mixed / 7), F.lit(1000))


def test_point(words: Column, *keys: Column) -> Column:
    """A position to ask at, from 1 to two before the end, by a hash of integer keys; null in sentences of fewer than three words."""
    return F.when(F.size(words) > 2, 1 + F.pmod(split_bucket(*keys), F.size(words) - 2))


def train_test(rows: DataFrame, keys: Sequence[str], ratio: float) -> DataFrame:
    """Add ``part``: train or test, per row by a hash of its integer keys (null keys count as 0)."""
    bucket = split_bucket(*[F.coalesce(F.col(k).cast("bigint"), F.lit(0)) for k in keys])
    return rows.withColumn("part", F.when(bucket < ratio * 1000, "train").otherwise("test"))


def boundaries(rows: DataFrame, ignore: Sequence[str] = ("^", ","), sentence: str = "sentence") -> DataFrame:
    """Every word of a sentence that may be asked for and the words before it: the other columns, pos, words, target.

    Marks in ``ignore`` are never asked for but stay among the words before others.
    """
    others = [c for c in rows.columns if c != sentence]
    at = rows.select(*others, F.split(sentence, " ").alias("w")).select(*others, "w", F.posexplode("w").alias("pos", "target"))
    return at.where(~F.col("target").isin(list(ignore))).select(*others, "pos", F.slice("w", F.lit(1), F.col("pos")).alias("words"), "target")


def ngram_rows(rows: DataFrame, n_min: int, n_max: int, sentence: str = "sentence") -> DataFrame:
    """Every word n-gram of n_min..n_max words where it stands: n, ngram."""
    w = F.split(sentence, " ")
    sized = rows.select(w.alias("w")).withColumn("n", F.explode(F.sequence(F.lit(n_min), F.lit(n_max)))).where(F.size("w") >= F.col("n"))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    return sized.select("n", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("ngram"))


def string_ngrams(rows: DataFrame, n_min: int, n_max: int, sentence: str = "sentence") -> DataFrame:
    """Word n-grams of n_min..n_max words with their counts: n, ngram, occurences."""
    return ngram_rows(rows, n_min, n_max, sentence).groupBy("n", "ngram").agg(F.count(F.lit(1)).alias("occurences"))
