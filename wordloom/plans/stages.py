"""Queries that pass through the stages' files, and the remaining operators on sentences and trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import corpus, dictionary, ngrams, suggest
from wordloom.plans import model as m
from wordloom.plans import text as t
from wordloom.sources import io
from wordloom.sources.tables import table
from wordloom.storage import materialize, workspace


def ngram_file_counts(spark: SparkSession, d: str) -> DataFrame:
    """Two- and three-word sequences written to text files, one a line, read again, counted and sorted: place, ngram, occurences."""
    parts = t.subsentence_split(spark, d).select(F.trim(F.lower("part")).alias("sentence")).where("sentence <> ''")
    path = workspace(spark, "ngram-files")
    io.write_text(corpus.ngram_rows(parts, 2, 3), "ngram", path)
    counts = io.text_lines(spark, path).groupBy(F.col("line").alias("ngram")).agg(F.count(F.lit(1)).alias("occurences"))
    return corpus.ordered_scan(counts, [F.desc("occurences"), F.asc("ngram")]).select((F.col("row_no") + 1).alias("place"), "ngram", "occurences")


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Word counts through a CSV file."""
    path = workspace(spark, "counts-csv")
    io.write_csv(t.word_counts(spark, d), path)
    return io.read_csv(spark, path, "word string, occurences bigint")


def stream_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as pickled lists, re-encoded as the stream of 32-bit numbers, and read again: ids, sentences."""
    pickled, flat = workspace(spark, "pickles"), workspace(spark, "stream")
    m.sentences(spark, d).select(io.to_pickles(F.col("words")).alias("content")).write.parquet(pickled)
    read = io.from_pickles(spark.read.parquet(pickled), "content")
    read.select(io.to_stream(F.col("words")).alias("content")).write.parquet(flat)
    words = io.from_stream(spark.read.parquet(flat), "content")
    return words.groupBy(m.path_text("words").alias("ids")).agg(F.count(F.lit(1)).alias("sentences"))


def table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary through a table that is created, filled in two parts, replaced by its own latest rows, exported and loaded."""
    path = workspace(spark, "word-table")
    words = table(spark, d, "word_t").where("id is not null").select("id", "word", "occurences", "loaded_at")
    io.open_or_create(spark, path, "id bigint, word string, occurences bigint, loaded_at timestamp_ntz")
    for k in (0, 1):
        io.append(words.where(F.pmod("id", F.lit(2)) == k), path)
    io.replace(spark.read.parquet(path).distinct(), path)
    # A stage whose table is there is not made again.
    kept = io.stage(spark, path, lambda: words.where("false"))
    io.export({"words": kept}, f"{path}-export")
    return io.load(spark, f"{path}-export", ["words"])["words"].select("id", "word", "occurences")


def odds_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Words by their odds to stand at any place, best first (unknown counts last, equals by id)."""
    words = m.stored(spark, d)["words"]
    odds = suggest.word_odds(words)
    return corpus.ordered_scan(odds, [F.desc_nulls_last("odds"), F.asc("id")]).select((F.col("row_no") + 1).alias("place"), "id", "odds")


def test_points(spark: SparkSession, d: str) -> DataFrame:
    """One place to ask at in every sentence of three words or more."""
    s = m.sentences(spark, d).where(F.size("words") > 2)
    return s.select("sent_id", corpus.test_point(F.col("words"), F.col("sent_id")).cast("bigint").alias("pos"), F.size("words").cast("bigint").alias("n"))


def text_hit_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Hits by rank of the string dictionary at every word of the masked sentences that may be asked for (no mark of a start or a comma)."""
    n = materialize(t.ngram_counts_n(spark, d), "ngrams")
    lists = dictionary.top_followers(n)
    rows = t.mask_rare(spark, d).select(F.concat_ws("/", "doc_id", "line_no", "sent_no").alias("sent"), "sentence")
    asked = materialize(corpus.boundaries(rows).where("pos > 0").withColumn("ctx_id", F.concat_ws("/", "sent", "pos")), "text-boundaries")
    found = dictionary.lookup(asked.select("ctx_id", "words"), lists.select("prefix", "suggestions")).join(asked.select("ctx_id", "target"), "ctx_id")
    tries = F.coalesce(F.array_position("suggestions", F.col("target")), F.lit(0)).cast("bigint")
    return found.groupBy(tries.alias("tries")).agg(F.count(F.lit(1)).alias("count"))


def moved_subtree(spark: SparkSession, d: str) -> DataFrame:
    """The trie of the sentences, with the sub-tree of the most frequent last word moved to that of the second; ids and parents anew."""
    tree = materialize(ngrams.path_counts(m.sentences(spark, d)), "trie")
    tops = [r["path"] for r in tree.where(F.size("path") == 1).orderBy(F.desc("occurences"), "path").limit(2).collect()]
    moved = ngrams.move_subtree(tree, tops[0], tops[1]) if len(tops) == 2 else tree
    return ngrams.number_tree(moved).withColumn("path", m.path_text("path"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (ngram_file_counts, csv_round_trip, stream_round_trip, table_round_trip, odds_ranking, test_points, text_hit_histogram, moved_subtree)
}

_LISTS = t.SQL["ngram_counts_n"].rsplit("SELECT n,", 1)
_LISTS = _LISTS[0].rstrip() + ", g AS (SELECT n," + _LISTS[1] + ")"

SQL: dict[str, str] = {
    "ngram_file_counts": "WITH c AS (" + t.SQL["string_ngrams"] + ") SELECT row_number() OVER (ORDER BY occurences DESC, ngram) AS place, ngram, occurences FROM c",
    "csv_round_trip": t.SQL["word_counts"],
    "stream_round_trip": f"WITH {m.SENTENCES} SELECT array_to_string(w, ' ') AS ids, count(*) AS sentences FROM s GROUP BY 1",
    "table_round_trip": "SELECT id, word, occurences FROM (SELECT DISTINCT id, word, occurences, loaded_at FROM word_t WHERE id IS NOT NULL)",
    "odds_ranking": """WITH w AS (SELECT id, occurences FROM (SELECT DISTINCT id, word, occurences, loaded_at FROM word_t WHERE id IS NOT NULL)),
o AS (SELECT id, occurences / nullif((SELECT CAST(sum(occurences) AS DOUBLE) FROM w) - occurences, 0) AS odds FROM w)
SELECT row_number() OVER (ORDER BY odds DESC NULLS LAST, id) AS place, id, odds FROM o""",
    "test_points": f"""WITH {m.SENTENCES}, a AS (SELECT sent_id, len(w) AS n, (CAST(1519531190 AS BIGINT) * 48271 + sent_id * 16807 + 12345) % 2147483647 AS x FROM s WHERE len(w) > 2)
SELECT sent_id, 1 + ((x // 7) % 1000) % (n - 2) AS pos, n FROM a""",
    "text_hit_histogram": _LISTS
    + """, ranked AS (SELECT prefix, follower, row_number() OVER (PARTITION BY prefix ORDER BY occurences DESC, follower) AS rank FROM g QUALIFY rank <= 5),
sent AS (SELECT row_number() OVER () AS k, string_split(sentence, ' ') AS w FROM masked),
spot AS (SELECT k, w, unnest(range(1, len(w))) AS i FROM sent),
ctx AS (SELECT k, i, w[i + 1] AS target, w[1:i] AS b FROM spot WHERE w[i + 1] NOT IN ('^', ',')),
ends AS (SELECT k, i, n, array_to_string(b[len(b) - n + 1:len(b)], ' ') AS prefix FROM ctx, (VALUES (1), (2), (3), (4)) AS v(n) WHERE n <= len(b)),
best AS (SELECT k, i, arg_max(prefix, n) AS prefix FROM ends WHERE prefix IN (SELECT prefix FROM g) GROUP BY 1, 2)
SELECT coalesce(rank, 0) AS tries, count(*) AS "count" FROM ctx LEFT JOIN best USING (k, i) LEFT JOIN ranked r ON r.prefix = best.prefix AND r.follower = target GROUP BY 1""",
    "moved_subtree": m.SQL["trie_counts"].rsplit("SELECT array_to_string", 1)[0].rstrip()
    + """, c AS (SELECT path, count(*) AS occurences FROM paths GROUP BY 1),
top AS (SELECT path[1] AS word, row_number() OVER (ORDER BY occurences DESC, path) AS place FROM c WHERE len(path) = 1),
moved AS (SELECT CASE WHEN path[1] = (SELECT word FROM top WHERE place = 1) THEN list_concat([(SELECT word FROM top WHERE place = 2)], path[2:]) ELSE path END AS path, occurences FROM c),
tree AS (SELECT path, CAST(sum(occurences) AS BIGINT) AS occurences FROM moved GROUP BY 1),
numbered AS (SELECT path, occurences, row_number() OVER (ORDER BY path) - 1 AS id FROM tree)
SELECT array_to_string(x.path, ' ') AS path, x.id, coalesce(y.id, -1) AS parent, x.occurences FROM numbered x LEFT JOIN numbered y ON len(x.path) > 1 AND y.path = x.path[1:len(x.path) - 1]""",
}
