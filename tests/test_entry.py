import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
CORE = ["p2_found", "p4_found", "p4_condition_totals", "p6_found", "p6_hierarchy", "normalize_lines", "mask_rare", "prefix_trie", "cleanup_words", "remap_prefixes", "suggest_topk", "kneser_ney", "combined_score"]
CORE += ["p4_prefix_states", "hit_histogram", "keystrokes", "suggest_hinted", "sorted_list", "ngram_file_counts", "csv_round_trip", "stream_round_trip", "table_round_trip", "odds_ranking"]
CORE += ["test_points", "text_hit_histogram", "moved_subtree", "normalize_commas", "normalize_common", "string_ngrams", "bayes_factors", "remap_ngrams"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: "N" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got.collect(), got.columns) == canon(want.fetchall(), want.columns)


def test_every_sql_has_a_query_and_the_flagship_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
