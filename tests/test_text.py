import random

import pytest
from pyspark.sql import functions as F

from heddle.functions import stemmer, text, tokenizer

TOKENS = {
    "C++ and C#": [],
    "iPhone 13 Pro": ["iphone", "pro"],
    "e-mail": ["e-mail"],
    "Dr. Smith": ["dr", "smith"],
    "12.5% increase": ["increase"],
    "U.S.A.": [],
    "'the' cat": ["the", "cat"],
    "&amp; &quot;x": ["amp", "quot"],
    "#tag@user end": ["tag", "user", "end"],
    "#one#two": ["one"],
    "#the #2024 #a": ["the", "2024"],
    "@user hello": ["hello"],
    "a@b.com next": ["next"],
    "state-of-the-art don't rock'n'roll": ["state-of-the-art", "don't", "rock'n", "roll"],
    "https://www.vogue.com/x": ["www", "vogue", "com"],
    "x--yy": ["yy"],
    "##foo": ["foo"],
    "café naïve": ["caf", "na", "ve"],
    "x" * 51: [],
    "Kelvin": ["elvin"],
    "": [],
    "   \r\n\t ": [],
}
STEMS = {
    "fashion": "fashion", "fashions": "fashion", "fashionable": "fashion", "design": "design", "designs": "design", "designer": "design",
    "designing": "designing", "clothing": "clothing", "clothes": "cloth", "cloth": "cloth", "shoes": "sho", "textile": "textil",
    "polyester": "polyest", "sustainable": "sustain", "sustainability": "sustainability", "organization": "organizat", "national": "nation",
    "relational": "relat", "conditional": "condit", "digitizer": "digit", "analysis": "analysi", "ties": "ti", "glass": "glass",
    "dresses": "dress", "controll": "control", "roll": "roll", "rate": "rate", "cease": "ceas", "it's": "it'", "be": "be", "s": "s",
}


def plain_tokens(s: str) -> list[str]:
    """The rules read letter by letter."""
    word = lambda c: c.isascii() and c.isalnum()
    out, now, i = [], "", 0

    def flush():
        nonlocal now
        if now and now not in tokenizer.STOP_WORDS and not now.startswith("http") and not now.isdigit():
            kept = now.rstrip("'")
            if 2 <= len(kept) <= 50:
                out.append(kept)
        now = ""

    while i < len(s):
        c = s[i]
        if word(c):
            now += c.lower()
        elif now and (c == "'" and "'" not in now or c == "-" and i + 1 < len(s) and word(s[i + 1])):
            now += c
        else:
            flush()
            if c == "@":
                while i < len(s) and s[i] not in " \t\n\r\f\v":
                    i += 1
            elif c == "#":
                j = i + 1
                while j < len(s) and (word(s[j]) or s[j] == "_"):
                    j += 1
                if j - i > 2:
                    out.append(s[i + 1 : j].lower())
                i = j
        i += 1
    flush()
    return out


def test_token_examples(spark):
    df = spark.createDataFrame([(k,) for k in TOKENS], "t string")
    assert {r[0]: r[1] for r in df.select("t", tokenizer.tokens(F.col("t"))).collect()} == TOKENS


def test_tokens_equal_the_letterwise_rules(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abTHe019'-#@_ \n.,é&", k=rng.randrange(60))) for _ in range(1500)] + ["a-" * 20000 + "b", "a" * 100000, None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tokenizer.tokens(F.col("t"))).collect()
    for i, tokens in got:
        assert tokens == plain_tokens(texts[i] or ""), texts[i][:80]


def test_stems_and_measure(spark):
    df = spark.createDataFrame([(k,) for k in STEMS], "w string")
    assert {r[0]: r[1] for r in df.select("w", stemmer.stem(F.col("w"))).collect()} == STEMS
    m = df.select("w", stemmer.measure(F.col("w")).alias("m")).where("w = 'sustainability'").first().m
    assert m == 5


@pytest.mark.parametrize(("value", "words", "hits"), [(None, 0, 0), ("", 0, 0), (" a  b\nc ", 3, 0), ("A silk DRESS in style", 5, 4)])
def test_counts(spark, value, words, hits):
    df = spark.createDataFrame([(value,)], "t string")
    assert tuple(df.select(text.word_count(F.col("t")), text.keyword_hits(F.col("t"))).first()) == (words, hits)
