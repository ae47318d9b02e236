import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from wordloom.llm.mixing import curriculum, mix, normalised, plan_mix, position, source_name


def records(n=3000):
    rng = random.Random(9)
    return [(k, rng.choice(["a", "a", "a", "b", "c", "z", None]), rng.choice([0, None, *range(1, 80)]), 0) for k in range(n)]


def supply_of(rows):
    s = Counter()
    for _, source, tokens, _ in rows:
        s[source] += tokens or 0
    return s


def test_shares_repeats_and_order(spark):
    rows = records()
    targets = {"a": (0.5, 1), "b": (0.3, 3), "c": (0.1, 2), "missing": (0.1, 4), "none": (None, None)}
    supply = supply_of(rows)
    plans = plan_mix(supply, targets)
    df = spark.createDataFrame(rows, "doc long, src string, n long, chunk int")
    got = mix(df, plans, "doc", "src", "n").collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and all(0 <= r.position <= 1 for r in got)
    tokens, uses = Counter(), Counter()
    for r in got:
        tokens[r.source] += r.tokens
        uses[r.source, r.doc] += 1
    whole = sum(tokens.values())
    for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert tokens[s] / whole == pytest.approx(want, rel=0.01)
        assert max(n for (x, _), n in uses.items() if x == s) <= targets[s][1]
    limiting = max(tokens, key=lambda s: tokens[s] / (supply[s] * targets[s][1]))
    assert tokens[limiting] >= 0.995 * supply[limiting] * targets[limiting][1]
    # Along the run a source's part follows its line from share * (1 - tilt) to share * (1 + tilt).
    slope, parts = {p.source: p.tilt for p in plans}, defaultdict(Counter)
    for r in got:
        parts[int(min(r.position, 0.999) * 4)][r.source] += r.tokens
    for k in range(4):
        for p in plans:
            expected = p.share * (1 + slope[p.source] * (2 * (k + 0.5) / 4 - 1))
            assert parts[k][p.source] / sum(parts[k].values()) == pytest.approx(expected, abs=0.03)


def test_weights_add_up_at_every_moment():
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    assert sum(shares[k] * v for k, v in curriculum(shares).items()) == pytest.approx(0)
    assert curriculum({"a": 1.0}) == {"a": 0.0}
    assert max(abs(v) for v in curriculum(shares, 0.3).values()) <= 0.3


def test_a_long_record_leaves_no_large_gap(spark):
    rows = [(0, "a", 5000, 0)] + [(k, "a", 10, 0) for k in range(1, 500)] + [(1000 + k, "b", 10, 0) for k in range(100)]
    plans = plan_mix(supply_of(rows), {"a": (0.5, 1), "b": (0.5, 1)})
    got = mix(spark.createDataFrame(rows, "doc long, src string, n long, chunk int"), plans, "doc", "src", "n").groupBy("source").sum("tokens").collect()
    assert {r[0]: r[1] for r in got} == {"a": 1000, "b": 1000}


def test_nothing_to_mix(spark):
    df = spark.createDataFrame([], "doc long, src string, n long")
    assert plan_mix({}, {"a": (1.0, 1)}) == [] and mix(df, [], "doc", "src", "n").collect() == []
    plans = plan_mix({"a": 5}, {"a": (1.0, 2)})
    assert mix(df, plans, "doc", "src", "n").collect() == []


def test_source_names(spark):
    df = spark.createDataFrame([(" Blogs\t",), (" NEWS ",), (None,)], "s string")
    assert [r[0] for r in df.select(source_name(df.s)).collect()] == ["blogs", "news", None]


def test_schedules_are_integrated_and_inverted(spark):
    points = normalised([(0.25, 0), (0.5, 4), (0.75, 0)])
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 0.0)
    with pytest.raises(ValueError):
        normalised([(0.5, 0.0)])
    df = spark.createDataFrame([(u / 20,) for u in range(21)], "u double").select("u", position(F.col("u"), points).alias("t"))
    at = lambda t: sum(max(0, min(t, b) - a) * (va + (vb - va) * (min(t, b) - a) / (b - a) / 2 * 1) if t > a else 0 for (a, va), (b, vb) in zip(points, points[1:]))
    for r in df.collect():
        assert at(r.t) == pytest.approx(r.u, abs=1e-9)


def test_a_source_comes_when_its_schedule_says(spark):
    rows = [(k, "ab"[k % 2], 10, 0) for k in range(2000)]
    plans = plan_mix(supply_of(rows), {"a": (0.5, 1), "b": (0.5, 1)}, schedules={"a": [(0, 1), (0.5, 0), (1, 0)]})
    got = mix(spark.createDataFrame(rows, "doc long, src string, n long, chunk int"), plans, "doc", "src", "n", chunk_rows=100).collect()
    assert len(got) == 2000 and max(r.position for r in got if r.source == "a") <= 0.5 and max(r.position for r in got if r.source == "b") > 0.9
