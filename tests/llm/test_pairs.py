import random
from collections import Counter
from itertools import combinations

from wordloom.llm import pairs
from wordloom.llm.pairs import PairTable

SCHEMA = "basket long, words array<long>, at int, word_a string"


def brute(baskets, least=1):
    n, ab = Counter(), Counter()
    for w in baskets.values():
        n.update(w)
        ab.update(combinations(sorted(w), 2))
    total = sum(bool(w) for w in baskets.values())
    return {p: (c, n[p[0]], n[p[1]], c * total / (n[p[0]] * n[p[1]])) for p, c in ab.items() if c >= least}


def scores(df):
    return {(r.word_a, r.word_b): (r.n_ab, r.n_a, r.n_b, r.lift) for r in df.collect()}


def test_changes_are_merged_like_a_new_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "SEGMENTS", 2)
    rng, baskets, table = random.Random(4), {}, PairTable(spark, str(tmp_path), buckets=3)
    assert table.scores().collect() == []
    for step in range(4):
        before = dict(baskets)
        batch = {rng.randrange(60): [rng.choice([None, *range(8)]) for _ in range(rng.randrange(0, 7))] for _ in range(40 if step != 2 else 3)}
        if step == 1:
            batch |= {k: None for k in list(baskets)[:5]}  # withdrawn
            batch |= {k: sorted(v) for k, v in list(baskets.items())[5:20] if k not in batch}  # again, unchanged
        rows = [(k, w, 1, "x") for k, w in batch.items()] + [(k, [99], 0, "x") for k in batch] + [(None, [1, 2], 1, "x")]
        table.apply(spark.createDataFrame(rows, SCHEMA))
        for k, w in batch.items():
            baskets[k] = {x for x in w or [] if x is not None}
        assert scores(table.scores()) == brute(baskets)
        assert table.n_baskets == sum(bool(w) for w in baskets.values())
        changed = Counter()
        for k in batch:
            changed.update({x: 1 for x in baskets[k]})
            changed.subtract({x: 1 for x in before.get(k, ())})
        words, old = {w for w, c in changed.items() if c}, brute(before)
        if len(table.segments) > 1:  # not just compacted
            assert scores(table.affected_scores(2)) == {p: v for p, v in brute(baskets, 2).items() if words & set(p) or v[0] != old.get(p, (0,))[0]}
        again = PairTable(spark, str(tmp_path))
        assert scores(again.scores()) == brute(baskets) and again.n_baskets == table.n_baskets
        assert {r.basket: set(r.words) for r in again.baskets().collect()} == {k: w for k, w in baskets.items() if w}
        again.close()


def test_a_long_basket_is_paired_in_blocks(spark):
    table = PairTable(spark).apply(spark.createDataFrame([(1, list(range(600)), 0, "x"), (2, [0, 599], 0, "x")], SCHEMA))
    assert table.counts("pairs").count() == 600 * 599 // 2
    assert {(r.word_a, r.word_b) for r in table.scores(2).collect()} == {(0, 599)}


def test_an_empty_batch(spark):
    assert PairTable(spark).apply(spark.createDataFrame([], SCHEMA)).scores().collect() == []


def test_a_batch_that_failed_is_not_seen(spark, tmp_path):
    table = PairTable(spark, str(tmp_path)).apply(spark.createDataFrame([(1, [1, 2], 0, "x")], SCHEMA))
    table._append("pairs", spark.createDataFrame([(1, 2, 5)], "word_a long, word_b long, d long"), 7)
    assert scores(PairTable(spark, str(tmp_path)).scores()) == {(1, 2): (1, 1, 1, 1.0)}


def test_nothing_stored_is_shuffled(spark, tmp_path):
    table = PairTable(spark, str(tmp_path))
    for k in range(2):
        table.apply(spark.createDataFrame([(k, [1, 2, 3], 0, "x")], SCHEMA))
    for df in (table.counts("pairs"), table.counts("marginals"), table.baskets()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan


def test_pair_counts_change_though_word_counts_do_not(spark):
    table = PairTable(spark).apply(spark.createDataFrame([(1, [1, 2], 0, "x"), (2, [3, 4], 0, "x")], SCHEMA))
    table.apply(spark.createDataFrame([(1, [1, 3], 1, "x"), (2, [2, 4], 1, "x")], SCHEMA))
    assert set(scores(table.affected_scores())) == {(1, 3), (2, 4)}
