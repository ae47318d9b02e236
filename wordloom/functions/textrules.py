"""Line and sentence normalisation as data: ordered regular-expression rules.

Every rule is a global, left-to-right, non-overlapping substitution on the result of
the rule before it; where matches share a blank, only the first of two neighbours
is replaced, and that is part of the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Replace ``pattern`` by ``to``; ``fold`` ignores ASCII case. The pattern PAD puts a blank at both ends."""

    pattern: str
    to: str
    fold: bool = False


PAD = "^|$"

# The rule tables, in their order.

_PUNCTUATION = [
    Rule("[\u2018-\u201b\u2032\u2035`]", "'"),
    Rule("[\u201c-\u201f\u2033\u2034\u2036\u2037\u2039\u203a\u2057\xab\xbb]", '"'),
    Rule("[\u2010-\u2015\u2043\xad]", "-"),
    Rule("[\u2024\u2027]", "."),
    Rule("\u2025", ".."),
    Rule("\u2026", "..."),
    Rule("[\u2000-\u200d\u2060\u202f\u205f]+", " "),
    Rule("\u2063", ","),
    Rule("\u2052", "%"),
    Rule("[\u204e\u2055\u2062]", "*"),
    Rule("\u2064", "+"),
]
#: The earlier generations keep the soft hyphen.
_PUNCTUATION_SOFT = [Rule("[\u2010-\u2015\u2043]", "-") if r.to == "-" else r for r in _PUNCTUATION]
_CONTROL = "[\r\ufeff\u200e\u200f\x80-\xbf\xd7\xf7]"
_SYMBOLS = r'[\]\[@{}<>()"|~`:*/%_#$,;+=^0-9\-]'
_SYMBOLS_KEEP_AT = r'[\]\[{}<>()"|~`:*/%_#$,;+=^0-9\-]'

_WORDS = [
    ("aint", "ain't"), ("cant", "can't"), ("couldnt", "couldn't"), ("doesnt", "doesn't"), ("dont", "don't"), ("didnt", "didn't"), ("hasnt", "hasn't"),
    ("havent", "haven't"), ("hadnt", "hadn't"), ("isnt", "isn't"), ("arent", "aren't"), ("wasnt", "wasn't"), ("werent", "weren't"), ("wont", "won't"),
    ("wouldnt", "wouldn't"), ("mustnt", "mustn't"), ("neednt", "needn't"), ("oughtnt", "oughtn't"), ("shant", "shan't"), ("shouldnt", "shouldn't"),
    ("id", "I'd"), ("youd", "you'd"), ("hed", "he'd"), ("youd", "you'd"), ("theyd", "they'd"),
    ("ive", "I've"), ("youve", "you've"), ("weve", "we've"), ("theyve", "they've"),
    ("im", "I'm"), ("youre", "you're"), ("hes", "he's"), ("shes", "she's"), ("theyre", "they're"),
]
_WILL = [("youll", "you'll"), ("itll", "it'll"), ("theyll", "they'll"), ("couldve", "could've"), ("shouldve", "should've"), ("wouldve", "would've")]
_IS = [
    ("lets", "let's"), ("thats", "that's"), ("heres", "here's"), ("theres", "there's"), ("whats", "what's"), ("whos", "who's"), ("wheres", "where's"),
    ("noones", "noone's"), ("everyones", "everyone's"), ("nowheres", "nowhere's"), ("everywheres", "everywhere's"), ("yall", "y'all"),
]
_SLANG = [("bday", "birthday"), ("dis", "this"), ("dat", "that")]
_SHORT = [
    ("c'mon", "come on"), ("(be?)?c[ou]z", "because"), ("imma", "I'm a"), ("ofcoz", "of course"), ("pl[sz]", "please"), ("ppl", "people"), ("tho", "though"), ("u", "you"), ("ur", "your"),
]
_OLD = [("o'", "of"), ("ol'", "old")]


def _standalone(pairs: Sequence[tuple[str, str]]) -> list[Rule]:
    return [Rule(f" {a} ", f" {b} ", True) for a, b in pairs]


_I = [Rule(" i ", " I "), Rule(" i'", " I'")]
_BARE = [Rule(" [^a-zA-Z]+", " "), Rule("[^a-zA-Z]+ ", " "), Rule(" [^a-zA-Z]+ ", " ")]
_SINGLE, _REPEATED, _BLANKS = Rule(" [^IAa] ", " "), Rule(r" \S*(\S)\1{3,}\S* ", " ", True), Rule(r"\s+", " ")
_COMMAS = Rule(r"(,\s*)+", " , ")
_INVALID = Rule(" [^ ]*[^ a-zA-Z0-9_'+-,][^ ]* ", " _ ")
_SPLIT_LINE = [*_PUNCTUATION_SOFT, Rule("\r", ""), Rule(PAD, " "), _COMMAS, _COMMAS, Rule(r"(,\s*)+\z", ""), Rule(r"^(\s*,)+", ""), Rule("[.!?]+", " \n ")]
_EDGES = [Rule(" [^a-zA-Z0-9,]+", " "), Rule("[^a-zA-Z0-9,]+ ", " ")]


@dataclass(frozen=True)
class RuleSet:
    """Rules for lines, then rules for the sentences that the lines fall into."""

    line: tuple[Rule, ...]
    sentence: tuple[Rule, ...]
    lower_first: bool = False
    splits: bool = False


_FULL_LINE = (*_PUNCTUATION, Rule(_CONTROL, ""), Rule(_SYMBOLS, " "), Rule(r"&\S*", " "), Rule(PAD, " "))
RULES = {
    "final": RuleSet(_FULL_LINE, (*_BARE, *_standalone(_WORDS + _WILL + _IS + _SLANG), *_I, *_standalone(_SHORT + _OLD), _SINGLE, _REPEATED, _BLANKS)),
    "app": RuleSet(_FULL_LINE, (*_BARE, *_standalone(_WORDS + _WILL + _IS + _SLANG), *_I, *_standalone(_SHORT), _SINGLE, _REPEATED, _BLANKS), lower_first=True),
    "plain": RuleSet(
        (*_PUNCTUATION, Rule(_CONTROL, " "), Rule(_SYMBOLS_KEEP_AT, " "), Rule(r"&\S*", " "), Rule(PAD, " ")),
        (*_BARE, Rule(" '+", " "), Rule("'+ ", " "), _SINGLE, Rule(_REPEATED.pattern, " "), _BLANKS),
    ),
    "commas": RuleSet(
        tuple(_SPLIT_LINE),
        (
            Rule("-{2,}", " "), Rule('[()":/_]', " "), *_EDGES, Rule(" [^a-zA-Z,]+ ", " "), *_standalone([*_WORDS, ("ill", "I'll"), *_WILL, *_IS]), *_I, Rule(" u ", " you "),
            *_standalone(_OLD), Rule(" '|' ", " "), Rule(" [^IAa,] ", " "), _INVALID, _COMMAS, _BLANKS,
        ),
        splits=True,
    ),
    "common": RuleSet(
        tuple(_SPLIT_LINE),
        (
            Rule(" i ", " I "), *_standalone(_OLD), Rule(" '|' |[()\":/_]", " "), Rule(" [^IAa,] ", " "), Rule(" [-0-9, ]*[0-9][-0-9, ]* ", " "), Rule(" [A-Z0-9]+ ", " _ "),
            Rule(" [^a-z,]+ ", " "), Rule("-{2,}", " "), _INVALID, *_EDGES, _COMMAS, _BLANKS,
        ),
        splits=True,
    ),
}
#: Blanks, and what ends a sub-sentence, in the first generation.
G1_BLANKS, G1_ENDS = "[ \t\u2000-\u200d\u2060\u202f\u205f]+", "[.,!?()\u2010-\u205e]"


def _step(c, rule: Rule):
    if rule.pattern == PAD:
        return F.concat(F.lit(" "), c, F.lit(" "))
    return F.regexp_replace(c, ("(?i)" if rule.fold else "") + rule.pattern, rule.to)


def _chain(c, rules: Sequence[Rule]):
    for r in rules:
        c = _step(c, r)
    return c


#: Rules in one step: the code generated for more would be too long for one method.
RUN = 10


def _blocks(rules: Sequence[Rule]) -> list[tuple[str | None, list[Rule]]]:
    """Cut the rules into runs; a run of rules that seldom apply has one pattern that tells whether any does."""
    seldom = lambda r: r.fold and r != _REPEATED or r in _I or r in _PUNCTUATION or r in _PUNCTUATION_SOFT
    out: list = []
    for r in rules:
        kind = seldom(r)
        if not out or out[-1][0] != kind or len(out[-1][1]) == RUN:
            out.append((kind, []))
        out[-1][1].append(r)
    return [("(?i)" + "|".join(r.pattern for r in run) if kind and len(run) > 2 else None, run) for kind, run in out]


def apply_rules(df: DataFrame, col: str, rules: Sequence[Rule]) -> DataFrame:
    """Run the rules over a column.

    A run of rules that seldom apply (punctuation of other kinds, contractions) is
    entered only by rows for which one of its patterns is found; for all others it is
    the identity, so the result is that of the plain chain at a fraction of the work.
    """
    for guard, run in _blocks(rules):
        c = F.col(col)
        df = df.withColumn(col, _chain(c, run) if guard is None else F.when(c.rlike(guard), _chain(c, run)).otherwise(c))
    return df


def normalise(df: DataFrame, col: str, rules: str = "final", number: str | None = None) -> DataFrame:
    """Replace ``col`` by its normalised sentences, one row each; empty ones are dropped.

    With a rule set that splits lines, ``number`` names a column for the sentence's
    place in its line.  Null lines give nothing; all other columns stay.
    """
    chosen = RULES[rules]
    df = df.where(F.col(col).isNotNull())
    if chosen.lower_first:
        df = df.withColumn(col, F.lower(col))
    df = apply_rules(df, col, chosen.line)
    if chosen.splits:
        df = df.withColumn("_line", F.monotonically_increasing_id())
        others = [c for c in df.columns if c != col]
        df = df.select(*others, F.posexplode(F.split(col, "\n")).alias(number or "_number", col))
    df = apply_rules(df, col, chosen.sentence)
    # The numbers keep filters from being moved below the rules, which would then run once more for each.
    df = df.select(*[c for c in df.columns if c != col], F.trim(col).alias(col), F.monotonically_increasing_id().alias("_row"))
    df = df.where((F.col(col) != "") & (F.col("_row") >= 0))
    if chosen.splits:
        df = df.where(F.col("_line") >= 0)
    return df.drop("_line", "_row", "_number")


def subsentences(df: DataFrame, col: str, number: str) -> DataFrame:
    """First generation: blanks become one, sub-sentence ends become line breaks, empty pieces go."""
    c = F.regexp_replace(F.regexp_replace(col, G1_BLANKS, " "), G1_ENDS, "\n")
    c = F.regexp_replace(F.regexp_replace(c, "^\n+", ""), r"\n+\z", "")
    others = [x for x in df.columns if x != col]
    return df.select(*others, F.posexplode(F.split(c, "\n+")).alias(number, col)).where(F.col(col) != "")
