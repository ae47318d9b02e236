import datetime as dt
import random

from pyspark.sql import functions as F

from wordloom.operators.orphans import Parent, Reference, dangling_references, key_runs

T0 = dt.datetime(2025, 1, 1)
REF, PAR = "k bigint, at timestamp_ntz, row bigint, target string, bucket string", "id bigint, since timestamp_ntz, until timestamp_ntz, pos string, kind string"


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def run(spark, refs, parents, skip=None):
    r = spark.createDataFrame([(k, day(a), n, "x", "y") for k, a, n in refs], REF)
    p = spark.createDataFrame([(i, day(s), day(u), "x", "y") for i, s, u in parents], PAR)
    out = dangling_references([Reference("a.k", "b", r, "k", "at", "row", skip)], [Parent("b", p, "id", "since", "until")])
    return sorted((x.row_key, x.ref_month) for x in out.collect())


def brute(refs, parents):
    ok = lambda k, a: a is not None and any(i == k and s is not None and s <= a and (u is None or u > a) for i, s, u in parents)
    return sorted({(n, None if a is None else day(a).strftime("%Y-%m")) for k, a, n in refs if k is not None and not ok(k, a)}, key=repr)


def test_against_brute_force_with_hot_keys_and_versions(spark):
    rng = random.Random(3)
    ids = [i for i in range(0, 400) if rng.random() < 0.7] + [20_000, 20_001, -3, -2]
    parents = [(i, rng.choice([0, 0, 0, 40]), rng.choice([None, None, 60])) for i in ids]
    parents += rng.sample(parents, 30) + [(5, 0, 10), (5, 50, None), (7, None, None), (None, 0, None)]
    refs = [(rng.choice([9, 9, 9, rng.randrange(-5, 420), 20_001, 20_002, None]), rng.choice([None, 5, 30, 45, 70, 100]), n) for n in range(3000)]
    refs += refs[:50]
    assert sorted(run(spark, refs, parents), key=repr) == brute(refs, parents)


def test_empty_sides_and_skipped_references(spark):
    assert run(spark, [], []) == []
    assert run(spark, [], [(1, 0, None)]) == []
    assert run(spark, [(1, 3, 10), (-1, 3, 11), (None, 3, 12)], [], F.col("k") == -1) == [(10, "2025-01")]


def test_runs_are_contiguous_and_end_at_gaps(spark):
    p = spark.createDataFrame([(i, day(0), None) for i in (1, 2, 3, 3, 7, 8, 16384)], "id bigint, since timestamp_ntz, until timestamp_ntz")
    got = sorted((r.run_start, r.run_end) for r in key_runs([Parent("b", p, "id", "since", "until")]).collect())
    assert got == [(1, 3), (7, 8), (16384, 16384)]
