"""The general data problems as queries over the project's tables (p2, p4, p6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import forest, hotkeys, orphans
from wordloom.sources.tables import table


def _dangling(spark: SparkSession, d: str) -> DataFrame:
    bayes = table(spark, d, "bayes_t").select("row_id", "conditional", "loaded_at")
    ngrams = table(spark, d, "ngram_t").select("row_id", "prefix", "follower", "loaded_at")
    prefixes = table(spark, d, "prefix_t").select("id", "parent", "loaded_at", "deleted_at")
    words = table(spark, d, "word_t").select("id", "loaded_at", "deleted_at")
    return orphans.dangling_references(
        [
            orphans.Reference("bayes_t.conditional", "word_t", bayes, "conditional", "loaded_at", "row_id"),
            orphans.Reference("ngram_t.prefix", "prefix_t", ngrams, "prefix", "loaded_at", "row_id"),
            orphans.Reference("ngram_t.follower", "word_t", ngrams, "follower", "loaded_at", "row_id"),
            orphans.Reference("prefix_t.parent", "prefix_t", prefixes, "parent", "loaded_at", "id", skip=F.col("parent") == -1),
        ],
        [
            orphans.Parent("prefix_t", prefixes, "id", "loaded_at", "deleted_at"),
            orphans.Parent("word_t", words, "id", "loaded_at", "deleted_at"),
        ],
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _dangling(spark, d).select("ref_field", "ref_month", "row_key").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per field and month."""
    return _dangling(spark, d).groupBy("ref_field", "ref_month").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("ref_key").alias("missing_keys"))


#: A key is hot if it holds more than one in so many rows.
HOT_ONE_IN = 50


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    def one(name: str, key: str) -> DataFrame:
        return hotkeys.hot_keys(table(spark, d, name), key, HOT_ONE_IN).select(F.lit(f"{name}.{key}").alias("key_field"), F.col(key).alias("hot_key"))

    return one("bayes_t", "condition").unionByName(one("ngram_t", "prefix"))


def p4_condition_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per condition of the pair table: rows, sum and extremes of the stored counts."""
    return hotkeys.fold_by_key(table(spark, d, "bayes_t"), "condition", "occurences").select("condition", "n_rows", "sum_value", "min_value", "max_value")


def p4_prefix_states(spark: SparkSession, d: str) -> DataFrame:
    """Per prefix: also first and last count in stored order, and how often it changes from row to row."""
    return hotkeys.fold_by_key(table(spark, d, "ngram_t"), "prefix", "occurences")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "prefix_t")
    return forest.hierarchy(nodes, with_paths=False).where("cycle_id is not null").select("id", "cycle_id")


def p6_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every node whose chain ends: root, depth, path as ids and as words, number of descendants."""
    nodes = table(spark, d, "prefix_t")
    tree = forest.materialize(forest.hierarchy(nodes), "forest-paths").where("cycle_id is null")
    below = forest.descendants(tree).groupBy("id").agg(F.count(F.lit(1)).alias("n_descendants"))
    spelled = forest.path_words(tree, nodes, table(spark, d, "word_t"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "/", "?")
    return spelled.join(below, "id", "left").select(
        "id", "root", "depth", "dangling", text("path").alias("path"), text("words").alias("words"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants")
    )


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return forest.descendants(forest.hierarchy(table(spark, d, "prefix_t")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_report, p4_found, p4_condition_totals, p4_prefix_states, p6_found, p6_hierarchy, p6_descendants)
}

_ORPHANS = """
WITH refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'bayes_t.conditional' AS ref_field, 'word_t' AS target, conditional AS k, loaded_at, row_id AS row_key FROM bayes_t
    UNION ALL SELECT 'ngram_t.prefix', 'prefix_t', prefix, loaded_at, row_id FROM ngram_t
    UNION ALL SELECT 'ngram_t.follower', 'word_t', follower, loaded_at, row_id FROM ngram_t
    UNION ALL SELECT 'prefix_t.parent', 'prefix_t', parent, loaded_at, id FROM prefix_t WHERE parent <> -1)
  WHERE k IS NOT NULL),
parents AS (
  SELECT 'word_t' AS target, id, loaded_at, deleted_at FROM word_t
  UNION ALL SELECT 'prefix_t', id, loaded_at, deleted_at FROM prefix_t),
found AS (
  SELECT ref_field, strftime(loaded_at, '%Y-%m') AS ref_month, row_key, k FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.target = r.target AND p.id = r.k AND p.loaded_at <= r.loaded_at
                    AND (p.deleted_at IS NULL OR p.deleted_at > r.loaded_at)))
"""

_WALK = """
WITH RECURSIVE nodes AS (SELECT id, min(parent) AS parent FROM prefix_t WHERE id IS NOT NULL GROUP BY id),
tops AS (SELECT id, parent FROM nodes WHERE parent IS NULL OR parent = -1 OR parent NOT IN (SELECT id FROM nodes)),
down(id, root, depth, path, dangling) AS (
  SELECT id, id, 0, [id], parent IS NOT NULL AND parent <> -1 FROM tops
  UNION ALL
  SELECT n.id, d.root, d.depth + 1, list_append(d.path, n.id), d.dangling FROM nodes n JOIN down d ON n.parent = d.id)
"""

SQL: dict[str, str] = {
    "p2_found": _ORPHANS + "SELECT DISTINCT ref_field, ref_month, row_key FROM found",
    "p2_report": _ORPHANS + "SELECT ref_field, ref_month, count(*) AS orphans, count(DISTINCT k) AS missing_keys FROM found GROUP BY 1, 2",
    "p4_found": """
SELECT 'bayes_t.condition' AS key_field, condition AS hot_key FROM bayes_t WHERE condition IS NOT NULL
GROUP BY condition HAVING count(*) * 50 > (SELECT count(*) FROM bayes_t)
UNION ALL SELECT 'ngram_t.prefix', prefix FROM ngram_t WHERE prefix IS NOT NULL
GROUP BY prefix HAVING count(*) * 50 > (SELECT count(*) FROM ngram_t)""",
    "p4_condition_totals": """
SELECT condition, count(*) AS n_rows, CAST(sum(occurences) AS BIGINT) AS sum_value, min(occurences) AS min_value, max(occurences) AS max_value
FROM bayes_t WHERE condition IS NOT NULL GROUP BY condition""",
    # In the order of the stored rows, which is that of the scan as long as a table is one file.
    "p4_prefix_states": """
WITH r AS (SELECT prefix, occurences AS v, row_number() OVER () AS rn FROM ngram_t),
s AS (SELECT *, row_number() OVER w > 1 AND v IS DISTINCT FROM lag(v) OVER w AS changed FROM r WHERE prefix IS NOT NULL WINDOW w AS (PARTITION BY prefix ORDER BY rn))
SELECT prefix, count(*) AS n_rows, CAST(sum(v) AS BIGINT) AS sum_value, min(v) AS min_value, max(v) AS max_value,
  (min_by([v], rn))[1] AS first_value, (max_by([v], rn))[1] AS last_value, count(*) FILTER (changed) AS changes FROM s GROUP BY prefix""",
    "p6_found": """
WITH RECURSIVE nodes AS (SELECT id, min(parent) AS parent FROM prefix_t WHERE id IS NOT NULL GROUP BY id),
ended(id) AS (
  SELECT id FROM nodes WHERE parent IS NULL OR parent = -1 OR parent NOT IN (SELECT id FROM nodes)
  UNION ALL SELECT n.id FROM nodes n JOIN ended e ON n.parent = e.id),
lost AS (SELECT id, parent FROM nodes WHERE id NOT IN (SELECT id FROM ended)),
walk(id, cur) AS (SELECT id, parent FROM lost UNION SELECT w.id, l.parent FROM walk w JOIN lost l ON w.cur = l.id),
ring AS (SELECT id FROM walk WHERE id = cur)
SELECT w.id, min(w.cur) AS cycle_id FROM walk w JOIN ring r ON r.id = w.cur GROUP BY w.id""",
    "p6_hierarchy": _WALK
    + """,
names AS (SELECT n.id, w.word FROM (SELECT id, min(word) AS word FROM prefix_t GROUP BY id) n
          LEFT JOIN (SELECT id, min(word) AS word FROM word_t WHERE id IS NOT NULL GROUP BY id) w ON n.word = w.id),
steps AS (SELECT d.id, unnest(d.path) AS node, unnest(range(1, len(d.path) + 1)) AS k FROM down d),
spelled AS (SELECT s.id, string_agg(coalesce(m.word, '?'), '/' ORDER BY s.k) AS words FROM steps s LEFT JOIN names m ON s.node = m.id GROUP BY s.id),
below AS (SELECT node AS id, count(*) - 1 AS n FROM steps GROUP BY node)
SELECT d.id, d.root, CAST(d.depth AS BIGINT) AS depth, d.dangling, array_to_string(d.path, '/') AS path, s.words, b.n AS n_descendants
FROM down d JOIN spelled s ON s.id = d.id JOIN below b ON b.id = d.id""",
    "p6_descendants": _WALK
    + """,
steps AS (SELECT id, unnest(path) AS node, unnest(range(1, len(path) + 1)) AS k, len(path) AS n FROM down)
SELECT node AS id, id AS descendant, n - k AS distance FROM steps WHERE node <> id""",
}
