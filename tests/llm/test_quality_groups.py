import random

from heddle.llm import quality

SCHEMA = "doc_id bigint, lang string, title string, text string, source string"
COMMON = "the of and to in that is was for it with as on at by not are but from or have an they which".split()


def words(rng: random.Random, syllables: list[str], n: int) -> list[str]:
    return ["".join(rng.choice(syllables) for _ in range(3)) for _ in range(n)]


def common(spark):
    return spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")


def test_a_rare_language_knows_its_own_words(spark):
    rng = random.Random(5)
    rows = [(d, "en", None, f"They said that the coat was not for sale in town {d % 7}.", "a") for d in range(20_000)]
    own = words(rng, ["vok", "mul", "tja", "rin", "hes", "bod", "kal"], 250)
    sentence = lambda vocabulary: " ".join(rng.choice(vocabulary) for _ in range(10)).capitalize() + "."
    junk = set()
    for d in range(30_000, 30_070):  # words of this language are in about 15 documents, less than 0.1 % of all
        if d % 7 == 0:
            junk.add(d)
            lines = [" ".join("".join(rng.choice("bcdfghjkqxzw") for _ in range(8)) for _ in range(10)) + "." for _ in range(7)]
        else:
            lines = [sentence(own) for _ in range(7)]
        rows.append((d, "xa", None, "\n".join(lines), "a"))
    few = words(rng, ["zir", "pol", "gam", "dut", "fel", "nok", "sav"], 300)
    rows += [(d, "xb", None, "\n".join(sentence(few) for _ in range(4)), "a") for d in range(40_000, 40_003)]  # too little text
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert {r.doc_id for r in quality.not_prose(docs, common(spark)).collect()} == junk


def test_more_than_half_holds_in_a_language_of_lists(spark):
    rows = []
    for d in range(300):
        if d < 100:
            lang, lists = "en", d % 20 == 0
        else:
            lang, lists = ("fr", "de")[d % 2], d % 10 < 7  # seven of ten are tables
        text = "\n".join(f"Item {d};{k};n/a;{k * d % 99}%" for k in range(12)) if lists else "\n".join(f"They said that the coat was not for sale, and it was {w}." for w in ("blue", "red", "grey"))
        rows.append((d, lang, None, text, "a"))
    wanted = {d for d, _, _, text, _ in rows if text.startswith("Item")}
    assert {r.doc_id for r in quality.not_prose(spark.createDataFrame(rows, SCHEMA), common(spark)).collect()} == wanted
