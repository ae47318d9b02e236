import os
import re

import numpy as np
import pytest
from residue_heldout import HELD_OUT, MENTIONED

from wordloom.llm import residue, residue_seeds

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"

PROSE = [
    "The ferry crew measured the dented bucket near the river, and nobody asked why it was so heavy.", "We walked along the canal after the storm and saw that the baker repaired the old fence.",
    "Nobody told me that the librarian planned the spring concert on Sunday night.", "Wir trafen elf Leute am Fluss, und meine Schwester plante den neuen Fahrplan.",
    "Nous avons vu deux personnes le long du canal, puis le boulanger a cherché les étagères.", "Todavía pienso en eso, sobre todo el martes pasado, porque nadie tenía tiempo.",
    "factor update done in 4711 ms", "block 8 read, 48 lines, 291 words kept", "Words seen only once are dropped; the dictionary keeps five of the spellings it started with.",
] * 40
RESIDUE = [
    "Please enable JavaScript to continue.", "404 Not Found", "{{city}} said the meeting about %TITLE% was moved.", "Dear undefined, thank you for your message about null.", "Lorem ipsum dolor sit amet, consectetur elit.",
    "Traceback (most recent call last):", "BITTE AKTIVIEREN SIE JAVASCRIPT, UM DIESE SEITE ZU SEHEN.", "Your  text  here.  Your  text  here.", "Access denied. You don't have permission to view this resource.", "[insert headline here]",
]
CLEAN = [
    "", "    ", "The word undefined is listed in the dictionary with twenty occurrences.", 'The format string "%s %d" prints a word and its count.', "Error 404 became the name of a café in the attic, and the sign is heavy.",
    "Access to the reading room was denied this morning, so that we could start early.", "My server answered 503 for two minutes before lunch, then the baker restarted it and all was well.",
    'Our filter looks for the phrase "enable JavaScript" and throws such lines away before the words are counted.', "Die Seite im Buch war nicht zu finden, also lachte die ganze Klasse.", *PROSE[:9],
]


@pytest.fixture(scope="module")
def model():
    return residue.fit(PROSE)


def test_alone_and_inside_prose(model):
    for text in RESIDUE:
        assert residue.localise(text, model), text
        whole = f"{PROSE[0]} {PROSE[1]}\n{text}\n{PROSE[2]}"
        spans = residue.localise(whole, model)
        assert spans and all(whole[s:e].strip() in text for s, e, *_ in spans), text


def test_mentions_and_prose_are_no_cases(model):
    for text in CLEAN:
        assert not residue.localise(text, model), text
        assert not residue.localise(f"{PROSE[1]} {text}", model), text


def test_whole_long_texts_are_read_in_spans(model, monkeypatch):
    monkeypatch.setattr(residue, "SPAN", 500)
    text = "\n".join(PROSE[:200]) + "\n404 Not Found"
    spans = residue.localise(text, model)
    assert [text[s:e] for s, e, *_ in spans] == ["404 Not Found"]
    assert not residue.localise("a" * 300_000, model)


def test_folding_keeps_positions():
    text = "İX 12  \ty\U0001f600"
    a = residue.fold(text)
    assert len(a) == len(text) and list(residue.squeezed(a)) == [True, True, True, True, True, True, False, False, True, True]
    assert len(residue.grams(a, 5)) == len(a) and residue.grams(np.zeros(0, np.uint32), 5).size == 0


def test_table_with_nulls_copies_and_other_columns(spark, model, rows):
    docs = [(1, RESIDUE[0], "k"), (2, RESIDUE[0], "k"), (3, None, "k"), (4, " ", "k"), (5, PROSE[0], "k"), (6, f"{PROSE[0]}\n{RESIDUE[1]}", "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, kind string")
    spans = residue.find_residue(df, "doc_id", "text", model)
    assert sorted({r.doc_id for r in spans.collect()}) == [1, 2, 6]
    acts = {r.doc_id: r.action for r in residue.exclusion(spans, df, "doc_id", df.text.substr(1, 10_000).isNotNull().cast("int") * 200).collect()}
    assert set(acts) == {1, 2, 6}
    assert residue.find_residue(df.where("false"), "doc_id", "text", model).collect() == []
    fitted = residue.fit_on(df, "doc_id", "text")
    assert fitted.long.shape == (4, 1 << residue.TABLE_BITS)


def sample():
    import pyarrow.parquet as pq

    return [t for t in pq.read_table(DOCUMENTS, columns=["text"])["text"].to_pylist() if t and 20 <= len(t) <= residue.SAMPLE_CHARS]


def shares(model, residues, others):
    """Recall and precision over single sentences."""
    found, wrong = sum(bool(residue.localise(s, model)) for s in residues), sum(bool(residue.localise(s, model)) for s in others)
    return found / len(residues), found / (found + wrong)


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="needs the test tables")
def test_held_out_wordings():
    recall, precision = shares(residue.fit(sample()), [s for group in HELD_OUT.values() for s in group], MENTIONED)
    assert recall >= 0.9 and precision >= 0.9


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="needs the test tables")
@pytest.mark.parametrize("part", [0, 1])
def test_families_left_out_of_the_fit(part):
    model = residue.fit(sample(), residue_seeds.seeds(part))
    left = {c: [s for k, family in enumerate(fs) if k % 2 == part for s in family[::5]] for c, fs in residue_seeds.families().items()}
    recall, precision = shares(model, [s for c in residue.CLASSES for s in left[c]], left["mention"])
    assert recall >= 0.7 and precision >= 0.9


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="needs the test tables")
def test_no_seed_is_taken_from_the_documents():
    plain = re.sub(r"[\s\xa0]+", " ", "\n".join(sample())).lower()
    fixed = {s for _, family in residue_seeds._library() for s in family} | set(residue_seeds.EMPTY_VALUES)
    seeds = {s for group in residue_seeds.seeds().values() for s in group if len(s) > 12} - fixed
    assert [s for s in seeds if s.lower().rstrip(".") in plain] == []


def test_rows_of_one_word_and_texts_without_any(model):
    assert residue.localise("satz satz satz satz satz satz", model) and not residue.localise("very very very long", model)
    assert list(residue._rows(residue.fold("a a a a a b"))) == [True] * 10 + [False] and not residue._rows(residue.fold("")).any()


def test_the_kind_of_a_document_is_that_of_most_characters(spark):
    spans = spark.createDataFrame([(1, 0, 5, "error"), (1, 9, 50, "notice"), (1, 90, 5, "error")], "doc_id long, start long, length long, kind string")
    docs = spark.createDataFrame([(1, "x" * 100, "e")], "doc_id long, text string, kind string")
    got = residue.exclusion(spans, docs, "doc_id", docs.text.substr(1, 100).isNotNull().cast("int") * 100).first()
    assert (got.kind, got.spans, got.residue_chars, got.action) == ("notice", 3, 60, "drop")
