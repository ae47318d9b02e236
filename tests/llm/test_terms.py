import random
from collections import Counter

import pytest

from wordloom.llm.plans import term
from wordloom.llm.suffixes import _stack, ngram_frequencies


def brute(records, sigma):
    total, records_of = Counter(), Counter()
    for terms, w in records:
        terms, seen = [t for t in terms or [] if t is not None], set()
        for i in range(len(terms)):
            for n in range(1, min(sigma, len(terms) - i) + 1):
                g = tuple(terms[i : i + n])
                total[g] += w or 0
                seen.add(g)
        records_of.update(seen)
    return {g: (len(g), total[g], records_of[g]) for g in total}


def got(spark, records, sigma):
    df = spark.createDataFrame([(t, w, "x", 1) for t, w in records], "words array<string>, w bigint, g1 string, total int")
    return {tuple(r.ngram): (r.n, r.total, r.records) for r in ngram_frequencies(df, "words", sigma, "w").collect()}


@pytest.mark.parametrize("sigma", [1, 2, 4])
def test_against_brute_force_with_a_hot_term(spark, sigma):
    rng = random.Random(sigma)
    records = [([rng.choice(["a", "a", "a", "b", "c", "dé", ""]) for _ in range(rng.randrange(0, 12))], rng.choice([None, 1, 5])) for _ in range(700)]
    records += [(None, 1), ([], 1), ([None, "a", None, "b"], 2), (["a"] * 300, 1)] + records[:20]
    assert got(spark, records, sigma) == brute(records, sigma)


def test_no_records(spark):
    assert got(spark, [], 3) == {}


def test_the_stack_closes_ngrams_across_batches():
    import pyarrow as pa

    rows = sorted([("a", "b"), ("a", "b"), ("a", "c"), ("a", None), ("b", "a"), ("b", None)], key=lambda r: (r[0], r[1] or ""), reverse=True)
    batches = [pa.RecordBatch.from_pydict({"g1": pa.array([r[0]]), "g2": pa.array([r[1]], pa.string()), "from_len": pa.array([1], pa.int32()), "seen": pa.array([0], pa.int32()), "total": pa.array([1]), "records": pa.array([1])}) for r in rows]
    out = {tuple(g): t for b in _stack(2)(iter(batches)) for g, t in zip(b["ngram"].to_pylist(), b["total"].to_pylist())}
    assert out == {("a",): 4, ("a", "b"): 2, ("a", "c"): 1, ("b",): 2, ("b", "a"): 1}


def test_terms_are_trimmed_and_unified(spark):
    df = spark.createDataFrame([(" \tDon’t ",), ("ʼTis",), (" ",), (None,)], "w string")
    assert [r[0] for r in df.select(term(df.w)).collect()] == ["don't", "'tis", "", None]


def test_batches_whose_fields_may_not_be_null():
    import pyarrow as pa

    schema = pa.schema([("g1", pa.string()), pa.field("from_len", pa.int32(), False), pa.field("seen", pa.int32(), False), ("total", pa.int64()), ("records", pa.int64())])
    batches = [pa.RecordBatch.from_pydict({"g1": [g], "from_len": [1], "seen": [0], "total": [n], "records": [1]}, schema=schema) for g, n in (("b", 2), ("b", 3), ("a", 1))]
    out = {tuple(g): t for b in _stack(1)(iter(batches)) for g, t in zip(b["ngram"].to_pylist(), b["total"].to_pylist())}
    assert out == {("b",): 5, ("a",): 1}
