import random
from collections import Counter
from itertools import combinations

import pytest

from wordloom.functions import sortedarrays as sa
from wordloom.functions.editdistance import list_distance, osa
from wordloom.operators import cleanup, cooccur, dictionary, evaluate, ngrams, suggest

RNG = random.Random(11)
SENTENCES = [[RNG.randrange(9) for _ in range(RNG.randrange(0, 9))] for _ in range(120)] + [None, [], [3], [None, 2, None, 4], list(range(700))]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(w, "x") for w in SENTENCES], "words array<bigint>, word_a string")


def known():
    return [[x for x in w if x is not None] for w in SENTENCES if w]


def test_pairs_of_sets(frame):
    n = Counter(p for w in known() for p in combinations(sorted(set(w)), 2))
    want = {(a, b, c) for (x, y), c in n.items() if c >= 2 for a, b in ((x, y), (y, x)) for c in [c]}
    assert {tuple(r) for r in cooccur.pair_counts(frame).collect()} == want


def test_pairs_of_positions(frame):
    n = Counter()
    for w in known():
        for a, b in combinations(w, 2):
            n[a, b] += 1
            if a != b:
                n[b, a] += 1
    assert {(r[0], r[1]): r[2] for r in cooccur.pair_counts_multiset(frame).collect()} == n


def test_factors_are_null_where_the_condition_decides(spark):
    pairs = spark.createDataFrame([(1, 2, 4), (2, 1, 2), (3, 1, 2)], "condition long, conditional long, occurences long")
    words = spark.createDataFrame([(1, 4), (2, 4), (3, 0)], "id long, occurences long")
    got = {r.condition: r.factor for r in cooccur.bayes_factors(pairs, words).collect()}
    assert got[1] is None and got[2] == (8 / 4 - 1) / (4 / 2 - 1)


def test_prefixes_and_tree(frame):
    f = Counter()
    for w in known():
        for p in range(1, len(w)):
            for k in range(1, min(4, p) + 1):
                f[tuple(w[p - k : p][::-1]), w[p]] += 1
    followers = ngrams.prefix_followers(frame)
    assert {(tuple(r.path), r.follower): r.occurences for r in followers.collect()} == f
    totals, kept = Counter(), Counter()
    for (path, _), n in f.items():
        totals[path] += n
        kept[path] += n > 1
    tree = {tuple(r.path): r for r in ngrams.prefix_tree(followers).collect()}
    assert set(tree) == {p for p in totals if kept[p]}
    visited = sorted(p for p, n in totals.items() if n > 1 and (len(p) == 1 or kept[p[:-1]]))
    assert {p: r.id for p, r in tree.items()} == {p: i for i, p in enumerate(visited) if kept[p]}
    assert all(r.occurences == totals[p] and r.word == p[-1] and r.parent == (tree[p[:-1]].id if len(p) > 1 else -1) for p, r in tree.items())


def test_level_wise_ngrams_equal_plain_counts(frame):
    want = Counter(tuple(w[i : i + n]) for w in known() for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert {tuple(r.ngram): r.occurences for r in ngrams.frequent_ngrams(frame, 3, 4).collect()} == {g: n for g, n in want.items() if n >= 4}


def test_cleanup_keeps_the_order_of_deletions(spark, rows):
    words = spark.createDataFrame([(i, str(i), i) for i in range(1, 6)], "id long, word string, occurences long")
    bayes = spark.createDataFrame([(1, 2, 5, 30.0), (1, 3, 5, 25.0), (1, 9, 5, 30.0), (2, 1, 5, None), (3, 1, 5, float("nan"))], "condition long, conditional long, occurences long, factor double")
    prefixes = spark.createDataFrame([(10, -1, 1, 9), (11, 10, 2, 9), (12, 11, 3, 9), (13, 12, 4, 9), (14, 99, 1, 9), (15, 14, 2, 9)], "id long, parent long, word long, occurences long")
    grams = spark.createDataFrame([(10, 2, 3, 9.0), (11, 4, 3, 1.0), (12, 4, 3, 9.0), (13, 4, 3, 9.0), (14, 4, 3, 9.0), (15, 5, 3, 9.0)], "prefix long, follower long, occurences long, factor double")
    out = cleanup.cleanup(words, bayes, prefixes, grams)
    # 13 is on the deleted level, 11 has no n-gram left, so 12 has no parent; 14 has none, but its child stays.
    assert [r.id for r in out["prefixes"].orderBy("id").collect()] == [10, 15]
    assert rows(out["bayes"]) == [(1, 2, 30.0)]
    assert [r.prefix for r in out["ngrams"].orderBy("prefix").collect()] == [10, 15]
    assert [r.id for r in out["words"].orderBy("id").collect()] == [1, 2, 5]
    assert [r.id for r in cleanup.cleanup(words, bayes, prefixes, grams, fixpoint=2)["prefixes"].collect()] == [10]
    assert {r.name: r.n for r in cleanup.model_counts(out).collect()} == {"words": 3, "bayes": 1, "prefixes": 2, "ngrams": 2}
    ids = cleanup.dense_ids(out["words"])
    assert rows(cleanup.remap(out["bayes"], {"condition": ids, "conditional": ids})) == [(1, 2, 30.0)]


def brute_suggest(ids, hint, words, bayes, prefixes, grams, k):
    total = sum(n for _, n in words.values())
    product = {}
    for w in ids:
        for (a, b), f in sorted(bayes.items()):
            if a == w and b not in ids and b in words and f is not None:
                product[b] = product[b] * f if b in product else words[b][1] / (total - words[b][1]) * f
    at = -1
    for w in reversed(ids[-4:]):
        if (at, w) not in prefixes:
            break
        at = prefixes[at, w]
    first = []
    for (p, c), (n, f) in grams.items():
        if p == at and words[c][0].startswith(hint):
            f = 1e100 if f is None else f
            if c in product:
                f *= product.pop(c)
            first.append((-(n * f / (1 + f)), c))
        elif p == at:
            product.pop(c, None)
    out = [(1, c) for _, c in sorted(first)]
    out += [(2, c) for _, c in sorted((-f, c) for c, f in product.items() if words[c][0].startswith(hint))]
    out = out[:k]
    large = sorted((-n, i) for i, (w, n) in words.items() if w.startswith(hint) and i not in {c for _, c in out})
    return [(r + 1, c, t) for r, (t, c) in enumerate((out + [(3, i) for _, i in large])[:k])]


def test_suggestions_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = {i: (rng.choice("ab") + rng.choice("xyz") + str(i), rng.randrange(1, 30)) for i in range(20)}
    bayes = {(rng.randrange(20), rng.randrange(20)): rng.choice([None, 0.01, 30.0, 2.5]) for _ in range(90)}
    prefixes, n = {}, 100
    for _ in range(25):
        prefixes.setdefault((-1, rng.randrange(20)), n)
        n += 1
    for parent in list(prefixes.values()):
        prefixes.setdefault((parent, rng.randrange(20)), n)
        n += 1
    grams = {(p, rng.randrange(20)): (rng.randrange(1, 9), rng.choice([None, 0.1, 3.0, 9.0])) for p in list(prefixes.values()) * 4}
    model = suggest.Model(
        spark.createDataFrame([(i, w, n) for i, (w, n) in words.items()], "id long, word string, occurences long"),
        spark.createDataFrame([(a, b, f) for (a, b), f in bayes.items()], "condition long, conditional long, factor double"),
        spark.createDataFrame([(i, p, w) for (p, w), i in prefixes.items()], "id long, parent long, word long"),
        spark.createDataFrame([(p, f, n, x) for (p, f), (n, x) in grams.items()], "prefix long, follower long, occurences long, factor double"),
    )
    asked = [(c, [rng.randrange(20) for _ in range(rng.randrange(0, 6))], h) for c in range(30) for h in ("", "a", "bx")]
    ids = {c: ids for c, ids, _ in asked}
    asked = [(c, ids[c], h) for c, _, h in asked]
    got = {}
    for r in suggest.suggest(spark.createDataFrame(asked, "ctx_id long, ids array<long>, hint string"), model, 4).collect():
        got.setdefault((r.ctx_id, r.hint), []).append((r.rank, r.id, r.tier))
    want = {(c, h): brute_suggest(i, h, words, bayes, prefixes, grams, 4) for c, i, h in asked}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}

    # Lists so short that places must be asked again give the same; so do all places of a line at once.
    monkeypatch.setattr(suggest, "LISTED", -3)
    monkeypatch.setattr(suggest, "BLOCK", 2)
    lines = spark.createDataFrame([(str(c), i) for c, i in ids.items()], "line string, ids array<long>")
    places = spark.createDataFrame([(str(c), p, h) for c, i in ids.items() for p in range(len(i) + 1) for h in ("", "a")], "line string, pos int, hint string")
    got = {}
    for r in suggest.suggest_lines(lines, places, model, 4).collect():
        got.setdefault((r.line, r.pos, r.hint), []).append((r.rank, r.id, r.tier))
    assert {k: sorted(v) for k, v in got.items()} == {(str(c), p, h): v for c, i in ids.items() for p in range(len(i) + 1) for h in ("", "a") if (v := brute_suggest(i[:p], h, words, bayes, prefixes, grams, 4))}
    assert suggest.suggest_lines(lines, places.where("false"), model, 4).collect() == []

    truth = [(c, ids[c], t, words[t][0]) for c in range(30) for t in [rng.randrange(20)]]
    strokes = {r.ctx_id: r.strokes for r in evaluate.keystrokes(spark.createDataFrame(truth, "ctx_id long, ids array<long>, target long, word string"), model, 3).collect()}
    for c, i, t, w in truth:
        hit = next((h for h in range(len(w)) if t in [x[1] for x in brute_suggest(i, w[:h], words, bayes, prefixes, grams, 3)]), None)
        assert strokes[c] == (len(w) if hit is None else hit + 1)


def test_typed_text(spark, rows):
    df = spark.createDataFrame([("how are y",), ("how are ",), ("x",), ("",), (None,)], "t string")
    assert rows(suggest.split_input(df, "t").select("finished", "hint")) == rows(spark.createDataFrame([("how are ", "y"), ("how are ", ""), ("", "x"), ("", ""), (None, None)], "a string, b string"))
    got = [r.accepted for r in suggest.accept(df.where("t <> ''").withColumn("w", df.t.substr(1, 1)), "t", "w").collect()]
    assert got == ["how are h ", "how are h ", "x "]


def brute_osa(a, b):
    from functools import cache

    @cache
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        return min(best, d(i - 2, j - 2) + 1) if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] else best

    return d(len(a), len(b))


def test_list_distance(spark):
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(6))] for _ in range(2))
        assert osa(a, b) == brute_osa(tuple(a), tuple(b))
    assert osa(list("ca"), list("abc")) == 3 and osa(list("ab"), list("ba"), 2, 2, 3, 1) == 1
    df = spark.createDataFrame([(["a", "b"], ["b", "a"]), (None, ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(list_distance(df.a, df.b)).collect()] == [1, 1]


def grams(spark):
    rows = [(1, "b", "x", 5), (1, "b", "y", 3), (1, "c", "x", 2), (1, "b", "z", 1), (2, "a b", "x", 4), (2, "a b", "y", 1), (2, "q c", "x", 2), (3, "k a b", "x", 4)]
    return spark.createDataFrame(rows, "n long, prefix string, follower string, occurences long")


def test_dictionary_moves_evicted_value_to_the_nearest_kept_prefix(spark, rows):
    lists = dictionary.top_followers(grams(spark), 2)
    assert {r.prefix: (r.total, r.suggestions) for r in lists.collect()}["b"] == (9, ["x", "y"])
    full = {r.prefix: r.value for r in dictionary.suggestion_dictionary(lists, ["x", "q"]).collect()}
    assert full == {"b": 9, "c": 2, "a b": 0, "q c": 0, "k a b": 4}
    small = {r.prefix: r.value for r in dictionary.suggestion_dictionary(lists, ["x", "q"], capacity=2).collect()}
    assert small == {"b": 9, "k a b": 4}
    one = {r.prefix: r.value for r in dictionary.suggestion_dictionary(lists, ["x", "q"], capacity=1).collect()}
    assert one == {"b": 13}
    found = dictionary.lookup(spark.createDataFrame([(1, ["z", "b"]), (2, ["k", "a", "b"]), (3, ["?"]), (4, [])], "ctx_id long, words array<string>"), dictionary.suggestion_dictionary(lists, ["x", "q"]))
    assert {r.ctx_id: r.prefix for r in found.collect()} == {1: "b", 2: "k a b", 3: None, 4: None}


def test_kneser_ney_by_hand(spark):
    p = {(r.prefix, r.follower): r.p for r in dictionary.kneser_ney(grams(spark)).collect()}
    assert p["b", "x"] == 5 / 9
    # "a b": cu 5, t 2, d = int(5 / 2 / 2) = 1; x occurs in 2 prefixes of two words, y in 1.
    wx, wy = (5 / 9) / 2, (3 / 9) / 1
    assert p["a b", "x"] == pytest.approx(3 / 5 + 2 / 5 / (wx + wy) * wx) and p["a b", "y"] == pytest.approx(0 + 2 / 5 / (wx + wy) * wy)


def test_combined_scores_and_choices(spark, rows):
    ctx = spark.createDataFrame([(1, [7, 8]), (2, [5]), (3, [])], "ctx_id long, words array<long>")
    p = spark.createDataFrame([(1, "8", 1, 0.5), (1, "8", 2, 0.5), (2, "7 8", 3, 1.0), (1, "5", 4, 1.0)], "n long, prefix string, follower long, p double")
    f = spark.createDataFrame([(7, 3, 3.0), (8, 3, 1.0), (5, 4, None)], "condition long, conditional long, factor double")
    scores = dictionary.combined_scores(ctx, p, f)
    assert rows(scores) == [(1, 3, 0.75), (2, 4, 1.0)]
    choices = spark.createDataFrame([(1, 3), (1, 9)], "ctx_id long, follower long")
    assert rows(dictionary.score_choices(scores, choices)) == [(1, 3, 0.75, 1), (1, 9, None, None)]


def test_sorted_arrays(spark):
    df = spark.createDataFrame([([1, 3, 3, 7],)], "a array<bigint>")
    a = df.a
    got = df.select(
        sa.add(a, 5), sa.update(a, a), sa.bisect_left(a, 3), sa.bisect_right(a, 3), sa.count(a, 3), sa.index(a, 7), sa.index(a, 8), sa.discard(a, 3), sa.discard(a, 9), sa.getitem(a, 0), sa.getitem(a, -2),
        sa.getitem(a, 9), sa.pop(a), sa.pop(a, 1), sa.pop(a, 9), sa.islice(a, 1, 3), sa.irange(a, 3, 7, (True, False)), sa.backwards(a), sa.repeat(a, 2), sa.sort_by_key(a, lambda v: -v),
    ).first()
    assert tuple(got) == (
        [1, 3, 3, 5, 7], [1, 1, 3, 3, 3, 3, 7, 7], 1, 3, 2, 3, None, [1, 3, 7], [1, 3, 3, 7], 1, 3, None, [1, 3, 3], [1, 3, 7], [1, 3, 3, 7], [3, 3], [3, 3], [7, 3, 3, 1], [1, 1, 3, 3, 3, 3, 7, 7], [7, 3, 3, 1],
    )


def test_a_moved_subtree_merges_with_what_is_there(spark):
    tree = spark.createDataFrame([([1], 3), ([1, 5], 2), ([1, 6], 1), ([2], 4), ([2, 5], 1), ([2, 5, 1], 1)], "path array<bigint>, occurences bigint")
    moved = ngrams.move_subtree(tree, [1], [2])
    assert {tuple(r.path): r.occurences for r in moved.collect()} == {(2,): 7, (2, 5): 3, (2, 6): 1, (2, 5, 1): 1}
    assert {tuple(r.path): (r.id, r.parent) for r in ngrams.number_tree(moved).collect()} == {(2,): (0, -1), (2, 5): (1, 0), (2, 5, 1): (2, 1), (2, 6): (3, 0)}
    assert ngrams.move_subtree(tree.where("false"), [1], [2]).collect() == []


def test_marks_are_not_asked_for_but_stand_before(spark):
    from wordloom.operators.corpus import boundaries

    df = spark.createDataFrame([(1, "^ a , b"), (2, None), (3, "")], "id int, sentence string")
    assert [(r.id, r.pos, r.words, r.target) for r in boundaries(df).where("target <> ''").orderBy("pos").collect()] == [(1, 1, ["^"], "a"), (1, 3, ["^", "a", ","], "b")]
