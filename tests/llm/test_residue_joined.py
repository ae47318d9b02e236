import pytest
from test_residue import PROSE

from wordloom.llm import residue


@pytest.fixture(scope="module")
def model():
    return residue.fit(PROSE)


@pytest.mark.parametrize("text", ["502 Bad Gateway", "Javascript is blocked.", "You have sent too many requests."])
def test_residue_after_prose_without_full_stop(model, text):
    whole = f"{PROSE[1]} a dozen more days along the canal and then the heavy bucket of the old librarian near the spring concert {text}"
    spans = residue.localise(whole, model)
    assert len(spans) == 1
    start, end = spans[0][:2]
    assert end == len(whole) and start >= len(whole) - len(text) - residue.WINDOW


def test_a_run_inside_a_sentence_is_no_case(model):
    assert not residue.localise("The service was unavailable to visitors two weeks ago, so the baker repaired the old fence near the river.", model)
