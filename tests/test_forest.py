import random

import pytest

from wordloom.operators.forest import descendants, hierarchy, path_words


def brute(links):
    parent = {}
    for i, p in links:
        if i is not None:
            p = None if p == -1 else p
            parent[i] = p if i not in parent or parent[i] is None else min(x for x in (p, parent[i]) if x is not None) if p is not None else parent[i]
    out = {}
    for i in parent:
        path, at = [], i
        while at in parent and at not in path:
            path.append(at)
            at = parent[at]
        if at in parent:
            out[i] = (None, None, None, None, min(path[path.index(at) :]))
        else:
            out[i] = (path[-1], len(path) - 1, path[::-1], at is not None, None)
    return out


def got(spark, links, **how):
    df = spark.createDataFrame([(i, p, 1, 2) for i, p in links], "id bigint, parent bigint, hops int, low int")
    return {r.id: (r.root, r.depth, r.path, r.dangling, r.cycle_id) for r in hierarchy(df, **how).collect()}


@pytest.mark.parametrize("size", [8, 40, 1000])
def test_random_graphs(spark, size):
    rng = random.Random(size)
    links = []
    for i in range(1, 160):
        links.append((i * 3, rng.choice([-1, i * 3 - 3, 3 * rng.randrange(1, 160), 3 * rng.randrange(1, max(2, i)), 3 * rng.randrange(1, max(2, i)), 7, None])))
    links += links[:10] + [(None, 3), (500, 500), (501, 502), (502, 503), (503, 501), (504, 501)]
    assert got(spark, links, fragment_nodes=size) == brute(links)


def test_long_chain_and_star_over_many_fragments(spark):
    chain = [(i, i - 1 if i > 1 else -1) for i in range(1, 200)]
    assert got(spark, chain, fragment_nodes=30) == brute(chain)
    star = [(1, -1)] + [(i, 1) for i in range(2, 200)]
    assert got(spark, star, fragment_nodes=30) == brute(star)


def test_empty_table_descendants_and_words(spark):
    assert got(spark, []) == {}
    df = spark.createDataFrame([(1, -1, 10), (2, 1, 11), (3, 2, 12), (9, 9, 10)], "id bigint, parent bigint, word bigint")
    tree = hierarchy(df)
    assert sorted(tuple(r) for r in descendants(tree).collect()) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    words = spark.createDataFrame([(10, "a"), (11, None), (12, "c"), (12, "d")], "id bigint, word string")
    spelled = {r.id: r.words for r in path_words(tree, df, words).collect()}
    assert spelled == {1: ["a"], 2: ["a", None], 3: ["a", None, "c"], 9: None}
