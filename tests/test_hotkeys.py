import random
from collections import defaultdict

import pytest

from wordloom.operators.hotkeys import fold_by_key, hot_keys, number_rows


def data(n=2000):
    rng = random.Random(5)
    return [(rng.choice([1, 1, 1, rng.randrange(50), None]), rng.choice([None, 1, 2, 3]), "x") for _ in range(n)]


@pytest.fixture(scope="module")
def frame(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hot") / "t")
    spark.createDataFrame(data(), "k bigint, v bigint, chunk string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("chunk", [7, 100, None])
def test_states_merge_over_chunk_borders(frame, chunk):
    by = defaultdict(list)
    for k, v, _ in data():
        if k is not None:
            by[k].append(v)
    got = {r["k"]: tuple(r)[1:] for r in fold_by_key(frame, "k", "v", chunk).collect()}
    want = {}
    for k, vs in by.items():
        known = [v for v in vs if v is not None]
        want[k] = (len(vs), sum(known) if known else None, min(known, default=None), max(known, default=None), vs[0], vs[-1], sum(a != b for a, b in zip(vs, vs[1:])))
    assert {k: v[:4] + v[6:] for k, v in got.items()} == {k: v[:4] + v[6:] for k, v in want.items()}
    assert {k: v[4:6] for k, v in got.items()} == {k: v[4:6] for k, v in want.items()}


def test_rows_are_numbered_once_and_keys_stay_together(frame):
    got = sorted((r.row_no, r.k) for r in number_rows(frame, "k").collect())
    assert [n for n, _ in got] == list(range(len(got)))
    seen = [k for _, k in got]
    assert sum(a != b for a, b in zip(seen, seen[1:])) == len(set(seen)) - 1


def test_hot_keys_count_null_rows_in_the_total_only(spark):
    df = spark.createDataFrame([(1,)] * 5 + [(2,)] * 2 + [(None,)] * 13, "k int")
    assert [r.k for r in hot_keys(df, "k", 5).collect()] == [1]
    assert hot_keys(df.where("false"), "k", 5).collect() == []
    assert hot_keys(df, "k", 4).collect() == []
