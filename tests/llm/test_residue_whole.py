import numpy as np
import pytest
from test_residue import PROSE, RESIDUE

from wordloom.llm import residue

LONG_TEXT = " ".join(f"The miller of village {chr(97 + i % 26)}{chr(97 + i // 26)} weighed the flour." for i in range(120))
TEXTS = [f"{PROSE[i % 9]} {PROSE[(i // 9) % 9]} {chr(97 + i % 26) * 3}" for i in range(1700)] + RESIDUE * 3 + ["ok", LONG_TEXT, f"{PROSE[0]}\n{RESIDUE[0]}"]


def same(a, b):
    return all(np.array_equal(getattr(a, f), getattr(b, f)) for f in ("long", "short", "unseen"))


@pytest.mark.parametrize("partitions", [1, 5])
def test_the_fit_takes_in_every_text_of_the_table(spark, partitions):
    assert len(LONG_TEXT) > 4000
    rows = [*enumerate(TEXTS), (-1, None), (-2, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    assert same(residue.fit_on(df, "doc_id", "text"), residue.fit([*TEXTS[::-1], " "]))


def test_one_more_text_changes_the_counts():
    whole, less = residue.learned(TEXTS, None), residue.learned([t for t in TEXTS if t != LONG_TEXT], None)
    assert np.array_equal(whole - less, residue.learned([LONG_TEXT], None)) and (whole - less).sum() > 2 * 4000


def test_counts_do_not_depend_on_how_texts_are_cut(monkeypatch):
    whole = residue._counts(TEXTS)
    monkeypatch.setattr(residue, "SPAN", 50)
    assert np.array_equal(whole, residue._counts(TEXTS))
    assert whole.sum(axis=1).tolist() == [sum(max(0, len(t) + 2 - n + 1) for t in map(" ".join, map(str.split, TEXTS))) for n in (residue.LONG, residue.SHORT)]


def test_weights_hold_for_a_larger_collection():
    few, many = residue.fit(TEXTS * 10), residue.fit(TEXTS * 20)
    assert np.array_equal(few.unseen, many.unseen) and np.allclose(few.long, many.long, atol=1e-4)


def test_an_empty_table_is_fitted_on_the_seeds(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert same(residue.fit_on(df, "doc_id", "text"), residue.fit([]))


def test_the_first_look_leaves_out_no_class_and_no_sentence():
    model = residue.fit(TEXTS[:40])
    a = residue.fold("  ".join(TEXTS[100:140] + RESIDUE))
    ratios = residue.Ratios(a, model)
    assert np.array_equal(ratios.highest(), ratios.of(np.arange(len(a))).max(axis=0))
    for text in ("a.\n\n b", "a. \n b", "\n\na?! \xa0b\n", ". ", "", "a.\x85b", "\n", "a\n. \n\nb."):
        ends = [m.end() for m in residue._END.finditer(text) if m.end() < len(text)]
        assert residue.bounds(text).tolist() == sorted({0, *ends})
