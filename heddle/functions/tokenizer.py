"""The document tokenizer as Column expressions: ASCII words, hashtags, mentions; a SQL form for other engines.

Runs of ASCII letters and digits are words; a word may hold one apostrophe and hyphens that a letter or digit follows.
``@`` skips to the next white space. ``#`` takes the letters, digits and underscores after it, as they are, and
swallows the byte behind. Words that are stop words, begin with http or are all digits are dropped before trailing
apostrophes are cut; what then has 2 to 50 characters is a token.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 41 stop words.
STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "any",
    "can", "her", "was", "one", "our", "out", "day", "get", "has",
    "him", "his", "how", "man", "new", "now", "old", "see", "two",
    "who", "boy", "did", "its", "let", "put", "say", "she", "too",
    "use", "way", "why", "yes", "yet",
)
MIN_LENGTH, MAX_LENGTH = 2, 50

#: Possessive, so that neither a long chain of hyphens nor a long word can exhaust the matcher's stack.
_WORD_JAVA = r"[A-Za-z0-9]++(?:-[A-Za-z0-9]++)*+(?:'[A-Za-z0-9]*+(?:-[A-Za-z0-9]++)*+)?"
MATCH_JAVA = r"#[A-Za-z0-9_]*+[\s\S]?|@\S*+\s?|" + _WORD_JAVA
MATCH_RE2 = r"#[A-Za-z0-9_]*[\s\S]?|@\S*\s?|[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*(?:'[A-Za-z0-9]*(?:-[A-Za-z0-9]+)*)?"


def matches(text: Column) -> Column:
    """Words, hashtags and mentions as they stand in the text."""
    return F.regexp_extract_all(text, F.lit(MATCH_JAVA), F.lit(0))


def is_filtered(word: Column) -> Column:
    """Whether a lower-case word is dropped: stop word, address or number."""
    return word.isin(*STOP_WORDS) | word.startswith("http") | word.rlike("^[0-9]+$")


def token(match: Column) -> Column:
    """The token of a match, null if it is dropped."""
    tag = F.lower(F.regexp_extract(match, "^#([A-Za-z0-9_]*)", 1))
    word = F.lower(match)
    kept = F.regexp_replace(word, "'+$", "")
    ordinary = F.when(~is_filtered(word) & F.length(kept).between(MIN_LENGTH, MAX_LENGTH), kept)
    return F.when(match.startswith("#"), F.when(F.length(tag) > 1, tag)).when(match.startswith("@"), F.lit(None)).otherwise(ordinary)


def tokens(text: Column) -> Column:
    """The tokens of a text in order; an empty array for a null text."""
    return F.coalesce(F.filter(F.transform(matches(text), token), lambda t: t.isNotNull()), F.array().cast("array<string>"))


def hashtags(text: Column) -> Column:
    """The hashtags of a text in order, without the # and in lower case."""
    found = F.transform(F.filter(matches(text), lambda m: m.startswith("#")), lambda m: F.lower(F.regexp_extract(m, "^#([A-Za-z0-9_]*)", 1)))
    return F.filter(found, lambda t: F.length(t) > 1)


def total_chars(token_array: Column) -> Column:
    return F.aggregate(token_array, F.lit(0).cast("bigint"), lambda n, t: n + F.length(t))


def tokens_sql(text: str) -> str:
    """The same as a SQL expression of RE2 patterns and list functions."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    pattern = MATCH_RE2.replace("'", "''")
    return (
        f"list_filter(list_transform(regexp_extract_all({text}, '{pattern}', 0), lambda m: CASE "
        f"WHEN m[1] = '#' THEN CASE WHEN length(regexp_extract(m, '^#([A-Za-z0-9_]*)', 1)) > 1 THEN lower(regexp_extract(m, '^#([A-Za-z0-9_]*)', 1)) END "
        f"WHEN m[1] = '@' THEN NULL "
        f"WHEN lower(m) IN ({stops}) OR starts_with(lower(m), 'http') OR regexp_matches(m, '^[0-9]+$') THEN NULL "
        f"WHEN length(regexp_replace(m, '''+$', '')) BETWEEN {MIN_LENGTH} AND {MAX_LENGTH} THEN lower(regexp_replace(m, '''+$', '')) END), lambda t: t IS NOT NULL)"
    )
