import re

import pytest

from wordloom.functions.stem import stem, stem_column
from wordloom.functions.textrules import PAD, RULES, normalise, subsentences
from wordloom.operators import corpus

LINES = [
    "I cant believe u didnt  come… im so sad :(", "  dont dont dont stop  ", "b c d a I x", "", "   ", "“Quoted” — it’s 100% (really) &amp; more", "sooooo goooood yesss",
    "C'mon ppl, becoz o' the ol' house; pls", "Hello, world! How are you? fine... ok", "ALL CAPS words 123 4-5 a-b -- x_y", "caf\xe9 \xe0 la carte   next", "i i'm i'll id ive", "a,b, ,c,,", "'tis 'quoted' rock'n'roll",
    "don’t ‘you’ lets thats yall", "aaaa AAAAh hmmmm\r", ".!?", "tab\there", "x" * 300 + " end", "the the dis dat bday",
]


def chain(text, rules):
    for r in rules:
        text = f" {text} " if r.pattern == PAD else re.sub(("(?ai)" if r.fold else "(?a)") + r.pattern.replace(r"\z", r"\Z"), r.to.replace("\\", r"\\"), text)
    return text


@pytest.mark.parametrize("name", list(RULES))
def test_rules_match_a_plain_chain(spark, name):
    rules = RULES[name]
    want = []
    for n, line in enumerate(LINES):
        line = chain(line.lower() if rules.lower_first else line, rules.line)
        for piece in line.split("\n") if rules.splits else [line]:
            s = chain(piece, rules.sentence).strip(" ")
            if s:
                want.append((n, s))
    df = spark.createDataFrame([(n, x, "k") for n, x in enumerate(LINES)] + [(99, None, "k")], "n int, line string, sent string")
    got = [(r.n, r.line) for r in normalise(df, "line", name).orderBy("n").collect()]
    assert sorted(got) == sorted(want)


def test_subsentences_and_lines(spark, rows):
    df = spark.createDataFrame([(1, "One,  two!\nthree (four)"), (2, ""), (3, None), (4, "...")], "doc_id int, text string")
    assert rows(corpus.lines(df)) == [(1, 0, "One,  two!"), (1, 1, "three (four)"), (2, 0, ""), (4, 0, "...")]
    parts = subsentences(corpus.lines(df), "line", "k").select("doc_id", "line_no", "line")
    assert rows(parts) == [(1, 0, " two"), (1, 0, "One"), (1, 1, "four"), (1, 1, "three ")]


def test_stems_of_the_published_vocabulary(spark):
    pairs = {
        "consistency": "consist", "consigned": "consign", "knightly": "knight", "generate": "generat", "generously": "generous", "happy": "happi", "cries": "cri", "ties": "tie", "gas": "gas", "this": "this",
        "kiwis": "kiwi", "hopping": "hop", "hoping": "hope", "relational": "relat", "falling": "fall", "skies": "sky", "news": "news", "succeed": "succeed", "it": "it", "dogs'": "dog", "controlled": "control",
    }
    assert {w: stem(w) for w in pairs} == pairs
    df = spark.createDataFrame([("Running",), (None,)], "w string")
    assert [r[0] for r in df.select(stem_column(df.w)).collect()] == ["run", None]


def test_dictionary_prefers_lower_case_and_numbers_densely(spark, rows):
    counts = spark.createDataFrame([("The", 3), ("the", 2), ("THE", 1), ("I", 4), ("once", 1), ("zoo", 2)], "word string, occurences long")
    assert rows(corpus.dictionary(counts)) == [(0, "I", 4), (1, "the", 6), (2, "zoo", 2)]
    assert corpus.dictionary(counts.where("false")).collect() == []


def test_coverage_ends_at_one_and_ties_go_by_word(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 6)], "word string, occurences long")
    got = [tuple(r) for r in corpus.coverage(counts).orderBy("idx").collect()]
    assert got == [(1, "c", 6, 0.6, 0.6), (2, "a", 2, 0.2, 0.8), (3, "b", 2, 0.2, 1.0)]


def test_encoding_bridges_unknown_words_and_masking_marks_them(spark, rows):
    s = spark.createDataFrame([(1, "The cat xx yy sat"), (2, "zz")], "k int, sentence string")
    words = spark.createDataFrame([(0, "cat"), (1, "sat"), (2, "the")], "id long, word string")
    assert rows(corpus.encode(corpus.tokens(s), words, ["k"])) == [(1, [2, 0, 1])]
    assert rows(corpus.mask_rare(corpus.tokens(s), words.select("word"), ["k"])) == [(1, "^ _ cat _ sat"), (2, "^ _")]
    a = spark.createDataFrame([(["_", "_", "a", "_"],)], "w array<string>")
    assert a.select(corpus.collapse_unknowns(a.w)).first()[0] == ["_", "a", "_"]


def test_ordered_scan_numbers_and_sums(spark):
    df = spark.range(1000).repartition(7)
    got = sorted((r.id, r.row_no, r.running) for r in corpus.ordered_scan(df, [df.id.desc()], "id").collect())
    assert [n for _, n, _ in got] == list(range(999, -1, -1))
    assert got[0][2] == sum(range(1000)) and got[-1][2] == 999


@pytest.mark.parametrize("name", ["final", "commas"])
def test_rules_run_once_whatever_is_filtered_above(spark, name):
    df = spark.createDataFrame([(1, "y'all yall")], "n int, line string")
    out = normalise(df, "line", name).where("line <> 'x' and line like '%a%'")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" y'all ") == 1


def test_spread_deals_a_small_scan_to_all_cores(spark, tmp_path):
    from wordloom.session import spread

    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "t"))
    small = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    assert spread(small).rdd.getNumPartitions() == cores and spread(small).count() == 50
    wide = spark.range(0, 50, 1, cores + 1)
    assert spread(wide) is wide
