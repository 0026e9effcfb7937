import random

import numpy as np

from heddle.llm import quality

SCHEMA = "doc_id bigint, lang string, title string, text string, tail string"
COMMON = "the of and to in that is was for it with as on at by not are but from or have an they which".split()
PROSE = ["The {n} was worn with a {n} and almost nothing else.", "They said that the {n} is not for sale, but it was.", "It is hard to say which of the {n} was from the mill.", "She had a {n} in the window, and they wanted it for the fair."]
NOUNS = [a + b for a in ("coat", "hat", "dress", "silk", "wool", "hem") for b in ("", "ery", "let", "man", "work", "yard")]


def corpus(n: int = 480):
    rng, rows = random.Random(4), []
    name = lambda: "".join(rng.choice(["ba", "ko", "ri", "lu", "ten"]) for _ in range(4)).capitalize()
    for d in range(n):
        kind = d % 24
        prose = [rng.choice(PROSE).format(n=rng.choice(NOUNS)) for _ in range(rng.randrange(6, 20))]
        if kind == 0:
            text = "\n".join(f"{k + 1}. {name()} {rng.choice(NOUNS)}" for k in range(15))
        elif kind == 1:
            text = "\n".join(f"{name()};{rng.randrange(99)};n/a;{rng.randrange(99)}%" for _ in range(15))
        elif kind == 2:
            text = " ".join(rng.choice(COMMON + NOUNS * 2) for _ in range(250))
        elif kind == 3:
            text = " ".join(prose).lower().replace(".", "").replace(",", "")
        elif kind == 4:
            text = "\n\n".join(prose).upper()
        else:
            text = "\n".join(prose)
        rows.append((d, rng.choice(["en", "EN ", "en", None]), None, text, "clash"))
    return rows


def test_tails_are_lists_tables_and_salads(spark):
    rows = corpus() + [(1000, "en", None, None, ""), (1001, "en", None, "", ""), (1002, "xx-long", None, " \n ", ""), (1003, "en", None, "koribaten " * 3000, ""), (1003, "en", None, "koribaten " * 3000, ""), (None, "en", None, "x", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    common = spark.createDataFrame([("en", w) for w in [*COMMON, None, "The"]], "lang string, word string")
    got = [r.doc_id for r in quality.not_prose(docs, common).collect()]
    assert sorted(got) == sorted([d for d in range(480) if d % 24 in (0, 1, 2)] + [1003])
    rows = quality.profiles(quality.statistics(docs, common)).collect()
    assert len(rows) == 485
    for r in rows:
        assert all(0 <= r[f"{s}_pct"] <= 100 and np.isfinite(r[f"{s}_z"]) for s in quality.STATISTICS)
        if r.doc_id in (1000, 1001, 1002):
            assert [r[s] for s in quality.STATISTICS] == [0] * 8 and not r["no_prose"]


def test_scores_follow_the_language(spark):
    """The same values are in the tail of one language and usual in another: spread and median are measured, not fixed."""
    rng = random.Random(3)
    row = lambda d, lang, symbols: (d, lang, 200.0, 4.5 + rng.random() / 10, symbols, 0.7 + rng.random() / 10, 0.4 + rng.random() / 50, 0.0, 0.02 + rng.random() / 50, 0.0, None)
    rows = [row(d, "xa", 0.02 + rng.random() / 100) for d in range(300)] + [row(1000 + d, "xb", 0.1 + 0.4 * rng.random()) for d in range(300)]
    rows += [row(5000, "xa", 0.3), row(5001, "xb", 0.3)]
    schema = "doc_id bigint, lang string, " + ", ".join(f"{s} double" for s in quality.STATISTICS) + ", residue boolean"
    got = {r.doc_id: r for r in quality.profiles(spark.createDataFrame(rows, schema)).collect()}
    assert got[5000].symbol_ratio_z > 8 and abs(got[5001].symbol_ratio_z) < 2
    assert got[5000].tails == ["symbol_ratio"] and not got[5000].no_prose


def test_prose_of_a_language_without_documents(spark):
    """A few articles in languages that the collection hardly holds are no junk."""
    polish = "Krawcowa z małego miasta szyła płaszcze przez trzydzieści lat, zanim ktokolwiek zapytał ją o zdanie. Dziś jej pracownia zatrudnia osiem osób, a zamówienia przychodzą z całej Europy. Nikt nie spodziewał się, że prosty wełniany płaszcz stanie się tak znany. Ona sama mówi, że liczy się tylko materiał."
    dutch = "De naaister uit het kleine dorp maakte dertig jaar lang jassen voordat iemand haar om haar mening vroeg. Nu werken er acht mensen in het atelier en komen de bestellingen uit heel Europa. Niemand had verwacht dat een eenvoudige wollen jas zo bekend zou worden. Zelf zegt ze dat alleen de stof telt."
    rows = corpus() + [(3000, "pl", None, polish, ""), (3001, None, None, polish + "\n\n" + polish[:200], ""), (3002, "nl", None, dutch, ""), (3003, "en", None, dutch, "")]
    common = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    got = {r.doc_id for r in quality.not_prose(spark.createDataFrame(rows, SCHEMA), common).collect()}
    assert not got & {3000, 3001, 3002, 3003}


def test_residue_is_left_to_its_own_operator(spark):
    rows = corpus(80) + [(2000, "en", None, "\n".join(f"{k}. {{{{ name }}}}" for k in range(20)), "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    common = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    assert 2000 not in {r.doc_id for r in quality.not_prose(docs, common).collect()}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.not_prose(empty, spark.createDataFrame([], "lang string, word string")).count() == 0
