"""Suggestions in passes: the same answers, and nothing left on disk between them."""

import os
import random

from wordloom import storage
from wordloom.operators import cooccur, suggest


def test_passes_long_lists_and_stretches_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    frame = spark.createDataFrame
    words = frame([(i, rng.choice("ab") + str(i), rng.randrange(1, 30)) for i in range(20)], "id long, word string, occurences long")
    bayes = frame([(a, b, rng.choice([None, 0.01, 30.0])) for a, b in {(rng.randrange(20), rng.randrange(20)) for _ in range(120)}], "condition long, conditional long, factor double")
    prefixes = frame([(100 + i, -1, i) for i in range(0, 20, 2)], "id long, parent long, word long")
    grams = frame([(100 + i, f, rng.randrange(1, 9), rng.choice([None, 0.1, 3.0])) for i in range(0, 20, 2) for f in rng.sample(range(20), 12)], "prefix long, follower long, occurences long, factor double")
    lines = frame([(c, [rng.randrange(20) for _ in range(7)]) for c in range(12)], "line long, ids array<long>")
    asks = frame([(c, p, "") for c in range(12) for p in range(8)], "line long, pos int, hint string")
    model = suggest.Model(words, bayes, prefixes, grams)
    answers = lambda: sorted(map(tuple, suggest.suggest_lines(lines, asks, model, 3).collect()))
    want = answers()
    assert len(want) == 12 * 8 * 3
    for name, value in (("PASS", 150), ("LONG", 0), ("CELLS", 8), ("LISTED", 0)):
        monkeypatch.setattr(suggest, name, value)
    assert answers() == want


def test_written_tables_go_when_released(spark):
    t = storage.materialize(spark.range(10).repartition(3), "released")
    assert t.count() == 10
    path = t._written_to.removeprefix("file://")
    assert os.path.isdir(path)
    storage.release(t)
    assert not os.path.exists(path) and all(p != t._written_to for _, p in storage._written)


def test_row_sums_of_all_pairs_for_the_wanted(spark):
    pairs = spark.createDataFrame([(1, 2, 3), (2, 1, 3), (1, 3, 1), (3, 1, 1), (2, 3, 2), (3, 2, 2)], "condition long, conditional long, occurences long")
    every = {(r.condition, r.conditional): tuple(r) for r in cooccur.row_sum_factors(pairs).collect()}
    wanted = spark.createDataFrame([(1, 3), (2, 3), (7, 8)], "condition long, conditional long")
    assert sorted(map(tuple, cooccur.row_sum_factors(pairs, wanted).collect())) == [every[1, 3], every[2, 3]]
