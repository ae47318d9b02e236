"""English stems (the public Snowball "English" algorithm), vectorised over distinct words."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogist": "og", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
_VOWEL = "[aeiouy]"
_R = re.compile("^.*?[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _regions(w: str) -> tuple[int, int]:
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    m = _R.match(w)
    r1 = len(head) if head else m.end() if m else len(w)
    m = _R.match(w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one word; words of two letters or less stay."""
    w = word.lower().replace("’", "'").lstrip("'")
    if len(w) < 3:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = re.sub(f"(?<={_VOWEL})y", "Y", re.sub("^y", "Y", w))
    r1, r2 = _regions(w)
    w = re.sub("'s'?$|'$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    # past and progressive forms
    e = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and re.search(_VOWEL, w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT_END.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # derivations
    e = _longest(w, [*_STEP2, "ogi", "li"])
    if e and len(w) - len(e) >= r1:
        if e in _STEP2:
            w = w[: -len(e)] + _STEP2[e]
        elif e == "ogi" and w.endswith("logi"):
            w = w[:-1]
        elif e == "li" and len(w) > 2 and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    e = _longest(w, [*_STEP3, "ative"])
    if e and len(w) - len(e) >= r1:
        if e != "ative":
            w = w[: -len(e)] + _STEP3[e]
        elif len(w) - 5 >= r2:
            w = w[:-5]
    e = _longest(w, [*_STEP4, "ion"])
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(e)]
    # a last e or l
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_column(word: Column) -> Column:
    """Stems of a column; null stays null. Apply it to distinct words."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return run(word)
