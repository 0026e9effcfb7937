"""The suffix-stripping stemmer as a Column expression and as SQL. Each step reads its input once.

A stem's measure is its number of vowel groups (a, e, i, o, u). In order: plural endings; five long endings behind a
vowel; ative, icate, alize, iciti behind a vowel; the first of a list of endings behind two vowel groups; a last e or
l. Words under three letters stay.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_V = "[aeiou]"
_TWO = f"{_V}[^aeiou]+{_V}"  # measure over 1
_CVC = "[^aeiou][aeiou][^aeiouwxy]$"
# Endings and what replaces them; {1} stands for the first group.
_PLURAL = ("^(.*?)(?:(ss)es|(i)es|(ss)|s)$", (1, 2, 3, 4), "")
_LONG = tuple((f"^(.*{_V}.*){old}$", (1,), new) for old, new in (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize")))
_DERIVED = (f"^(.*{_V}.*)(?:(ic)ate|ative|(al)ize|(ic)iti)$", (1, 2, 3, 4), "")
_ENDINGS = (
    f"^(.*?{_TWO}.*?)(?:al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ou|ism|ate|iti|ous|ive|ize)$|^(.*{_TWO}.*[st])ion$",
    (1, 2),
    "",
)
STEPS = (_PLURAL, *_LONG, _DERIVED, _ENDINGS)


def measure(word: Column) -> Column:
    """Number of vowel groups."""
    return F.regexp_count(word, F.lit(f"{_V}+"))


def _last_letter(x: Column) -> Column:
    short = F.substr(x, F.lit(1), F.length(x) - 1)
    drop_e = x.endswith("e") & (short.rlike(_TWO) | (short.rlike(_V) & ~short.rlike(_CVC)))
    drop_l = x.endswith("ll") & x.rlike(_TWO)
    return F.when(drop_e | drop_l, short).otherwise(x)


def stem(word: Column) -> Column:
    """The stem of a lower-case ASCII word."""
    x = word
    for pattern, groups, tail in STEPS:
        x = F.regexp_replace(x, pattern, "".join(f"${g}" for g in groups) + tail)
    # the one-element array binds the nested steps to a name, so that they are evaluated once
    return F.when(F.length(word) < 3, word).otherwise(F.element_at(F.transform(F.array(x), _last_letter), 1))


def stem_ctes(source: str, name: str = "stems") -> str:
    """SQL of a table ``name`` (token, stem) from a table with distinct tokens; one CTE for the endings, one for the last letter."""
    x = "token"
    for pattern, groups, tail in STEPS:
        x = f"regexp_replace({x}, '{pattern}', '{''.join(f'\\{g}' for g in groups)}{tail}')"
    short = "substr(x, 1, length(x) - 1)"
    return f"""
    {name}_x AS (SELECT token, {x} AS x FROM {source}),
    {name} AS (SELECT token, CASE WHEN length(token) < 3 THEN token
        WHEN x LIKE '%e' AND (regexp_matches({short}, '{_TWO}') OR (regexp_matches({short}, '{_V}') AND NOT regexp_matches({short}, '{_CVC}'))) THEN {short}
        WHEN x LIKE '%ll' AND regexp_matches(x, '{_TWO}') THEN {short} ELSE x END AS stem FROM {name}_x)"""
