"""The text rules as SQL text, for comparing results with another engine."""

from __future__ import annotations

from collections.abc import Sequence

from wordloom.functions.textrules import G1_BLANKS, G1_ENDS, PAD, RULES, Rule

#: That engine knows no back-references: a repeated letter is spelled out for every letter that occurs in words.
_LETTERS = "abcdefghijklmnopqrstuvwxyz'" + "\xe4\xf6\xfc\xdf\xe9\xe8\xe0\xe7\xf1\xe1\xed\xf3\xfa\xea\xee\xf4\xfb" + ".!?"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pattern(rule: Rule) -> str:
    pattern = rule.pattern
    if r"(\S)\1{3,}" in pattern:
        letters = _LETTERS if rule.fold else _LETTERS + _LETTERS.upper().replace("SS", "")
        escaped = ["\\" + c if c in ".?" else c for c in dict.fromkeys(letters)]
        pattern = pattern.replace(r"(\S)\1{3,}", "(?:" + "|".join(c + "{4,}" for c in escaped) + ")")
    return ("(?i)" if rule.fold else "") + pattern


def chain(expr: str, rules: Sequence[Rule]) -> str:
    for r in rules:
        expr = f"' ' || {expr} || ' '" if r.pattern == PAD else f"regexp_replace({expr}, {quote(_pattern(r))}, {quote(r.to)}, 'g')"
    return expr


LINES = """lines AS (SELECT doc_id, source, lang, unnest(range(len(p))) AS line_no, unnest(p) AS line
  FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))"""


def sentences(rules: str) -> str:
    """CTEs ``lines`` and ``sentences`` (doc_id, line_no, sent_no, sentence)."""
    r = RULES[rules]
    line = chain("lower(line)" if r.lower_first else "line", r.line)
    split = "string_split(c, chr(10))" if r.splits else "[c]"
    return f"""{LINES},
cut AS (SELECT doc_id, line_no, {split} AS p FROM (SELECT doc_id, line_no, {line} AS c FROM lines)),
pieces AS (SELECT doc_id, line_no, unnest(range(len(p))) AS sent_no, unnest(p) AS piece FROM cut),
sentences AS (SELECT * FROM (SELECT doc_id, line_no, sent_no, trim({chain("piece", r.sentence)}, ' ') AS sentence FROM pieces) WHERE sentence <> '')"""


def tokens(rules: str) -> str:
    """Also ``tokens`` (doc_id, line_no, sent_no, pos, word)."""
    return (
        sentences(rules)
        + """,
tokens AS (SELECT * FROM (SELECT doc_id, line_no, sent_no, unnest(range(len(w))) AS pos, unnest(w) AS word
  FROM (SELECT doc_id, line_no, sent_no, string_split(sentence, ' ') AS w FROM sentences)) WHERE word <> '')"""
    )


SUBSENTENCES = f"""{LINES},
cut AS (SELECT doc_id, line_no, string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, {quote(G1_BLANKS)}, ' ', 'g'),
  {quote(G1_ENDS)}, chr(10), 'g'), '^\\n+', '', 'g'), '\\n+\\z', '', 'g'), '\\n+') AS p FROM lines),
subsentences AS (SELECT * FROM (SELECT doc_id, line_no, unnest(range(len(p))) AS part_no, unnest(p) AS part FROM cut) WHERE part <> '')"""
