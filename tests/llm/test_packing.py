import random
from collections import defaultdict

import pytest

from wordloom.llm.packing import SumOfSquares, fill, pack
from wordloom.llm.tokens import token_count


def test_each_item_goes_where_the_squares_grow_least():
    rng, b = random.Random(6), 12
    packer, levels = SumOfSquares(b), {}
    for _ in range(400):
        size = rng.randrange(1, b + 1)
        squares = lambda ls: sum(n * n for n in __import__("collections").Counter(x for x in ls if 0 < x < b).values())
        options = [squares([*levels.values(), size])] + [squares([*(v for k, v in levels.items() if k != c), levels[c] + size]) for c in levels if levels[c] + size <= b]
        container, full = packer.place(size)
        levels[container] = levels.get(container, 0) + size
        assert levels[container] <= b and full == (levels[container] == b)
        assert squares(levels.values()) == min(options)
        if full:
            del levels[container]


@pytest.mark.parametrize("group", [50, 10_000])
def test_nothing_is_lost_split_or_overfull(spark, group):
    rng = random.Random(8)
    items = [(k, rng.choice([None, 0, rng.randrange(1, 60), rng.randrange(1, 60), 700]), "x") for k in range(900)] + [(5, 10, "x"), (5, 10, "x")]
    df = spark.createDataFrame(items, "doc long, size long, container string")
    out = pack(df, "doc", "size", {"s": 64, "m": 256}, group_items=group)
    rows = out.collect()
    for kind, cap in (("s", 64), ("m", 256)):
        load, pieces = defaultdict(int), defaultdict(list)
        for r in rows:
            if r.container == kind:
                pieces[r.doc].append((r.piece, r.token_start, r.tokens))
                if r.container_id is None:
                    assert r.tokens == 0
                else:
                    load[r.container_id] += r.tokens
        assert max(load.values()) <= cap
        assert sum(load.values()) == sum(s or 0 for _, s, _ in items)
        for k, size, _ in items[:5] + items[6:900]:
            got = sorted(pieces[k])
            assert sum(t for *_, t in got) == (size or 0) and (len(got) == max(1, -(-(size or 0) // cap)))
            assert [s for _, s, _ in got] == [p * cap for p, *_ in got]
        assert len(load) <= 1.05 * -(-sum(load.values()) // cap) + 2
    again = {(r.container, r.container_id, r.doc, r.piece) for r in pack(df.repartition(7), "doc", "size", {"s": 64, "m": 256}, group_items=group).collect()}
    assert again == {(r.container, r.container_id, r.doc, r.piece) for r in rows}
    assert abs(sum(r.tokens for r in fill(out).collect()) - 2 * sum(s or 0 for _, s, _ in items)) == 0


def test_no_items(spark):
    assert pack(spark.createDataFrame([], "doc long, size long"), "doc", "size", {"s": 4}).collect() == []


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("hello world",), ("a" * 200_000,), ("<|endoftext|>",)], "t string")
    n = [r[0] for r in df.select(token_count(df.t)).collect()]
    assert n[:4] == [0, 0, 1, 2] and n[4] > 1000 and n[5] > 1
