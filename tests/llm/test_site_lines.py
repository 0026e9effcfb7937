import random
import re
from collections import defaultdict

from heddle.llm import site_lines

SCHEMA = "doc_id bigint, source string, text string, line_no int, chunk string"
NOTICES = ["Edited for length and clarity by the desk on 3/4/2020", "© 2019 The Selvage — all rights reserved everywhere", "short one", "Très élégante ligne répétée partout, été 12", "twenty letters exactly"]


def norm(line):
    return re.sub(r"[\W_]+", " ", re.sub(r"\d+", "0", line.lower())).strip()


def corpus():
    rng, rows = random.Random(7), []
    for d in range(120):
        source = rng.choice(["A", " a ", "A", "b", "C", None, "c "])
        lines = [" ".join(rng.choice(["silk", "coat", "wool", "red", "Straße", "été", "x9"]) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(0, 8))]
        lines += [n.upper() if rng.random() < 0.3 else re.sub(r"\d+", str(rng.randrange(9999)), n) for n in NOTICES if rng.random() < 0.3]
        rng.shuffle(lines)
        rows.append((d, source, rng.choice(["\n", "\r\n", "\n\n"]).join(lines), 1, "clash"))
    rows += [(500, "a", None, 1, ""), (501, "a", "", 1, ""), (502, "a", " \n\n ", 1, ""), (None, "a", NOTICES[0], 1, ""), rows[0], rows[1]]
    rows.append((503, "a", "word " * 200_000, 1, ""))
    return rows


def brute(rows):
    where, lines = defaultdict(set), []
    for d, s, t, *_ in rows:
        if d is None or s is None or t is None:
            continue
        for k, line in enumerate(t.split("\n"), 1):
            n = norm(line)
            if sum(c.isalpha() for c in n) >= 20:
                key = (s.strip().lower(), n)
                where[key].add(d)
                lines.append((d, k, key))
    return {(d, k) for d, k, key in lines if len(where[key]) >= 4}


def test_equals_line_by_line_count(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [(r.doc_id, r.line_no) for r in site_lines.repeated_lines(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_removal_and_empty(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    cut = brute(rows)
    out = site_lines.without_repeated_lines(df).collect()
    assert len(out) == len(rows)
    for r in out:
        before = [t for d, _, t, *_ in rows if d == r.doc_id]
        if r.text is None:
            assert before == [None] or r.doc_id is None
            continue
        wanted = ["\n".join(x for k, x in enumerate(t.split("\n"), 1) if (r.doc_id, k) not in cut) for t in before if t is not None]
        assert r.text in wanted
    assert site_lines.repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunks_of_equal_text_are_equal_elsewhere(spark):
    body = " ".join(f"palabra{chr(97 + k % 26)}{chr(97 + k % 7)}" for k in range(400))
    df = spark.createDataFrame([(1, "a", "intro one two " + body, 1, ""), (2, "a", "another quite different opening\nof it " + body.replace(" ", "\n"), 1, ""), (3, "a", "x " + body, 1, "")], SCHEMA)
    one, two, three = (set(r.symbols) for r in site_lines.chunked(df).orderBy("page").collect())
    assert len(one & three) >= 0.9 * len(one) > 10
    assert len(two) < 300  # of 400 lines: line ends are text like any other, not cuts


NOTICE = "The material on this site may not be copied, sent on or stored without the written permission of its owner, who may be asked by letter in the year 2021 or later, at the address that stands in the imprint of every printed number since the first"


def without_line_ends(k: int) -> str:
    rng = random.Random(k)
    words = lambda n: " ".join("".join(rng.choice("abcdeéilmnorst") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    return f"{words(40)} {NOTICE.replace('2021', str(2000 + k))} {words(30)}"


def test_stretches_of_texts_without_line_ends(spark):
    rows = [(k, "a", without_line_ends(k), 1, "clash") for k in range(200)] + [(900 + k, "b", without_line_ends(900 + k), 1, "") for k in range(3)]
    rows += [(1000, None, NOTICE, 1, ""), (1001, "a", None, 1, ""), (1002, "a", "", 1, ""), (None, "a", NOTICE, 1, ""), rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = site_lines.without_repeated_text(df).collect()
    assert len(out) == len(rows)
    for r in out:
        before = [t for d, _, t, *_ in rows if d == r.doc_id][0]
        if r.doc_id is None or r.source != "a" or not before:
            assert r.text == before and r.stretches_cut == 0
            continue
        assert r.stretches_cut >= 1 and "written permission" not in r.text and "by letter in the year" not in r.text
        assert len(set(NOTICE.split()) & set(r.text.split())) < 0.5 * len(set(NOTICE.split()))
        own = [w for w in before.split() if w not in NOTICE.replace("2021", str(2000 + r.doc_id)).split()]
        assert [w for w in r.text.split() if w in set(own)] == own  # nothing else is lost
    assert site_lines.without_repeated_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_are_hashed_in_parts(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    data, starts = rng.integers(97, 120, 5000).astype(np.uint8), np.sort(rng.choice(np.arange(1, 5000), 200, replace=False))
    starts = np.append(0, starts)
    salt = rng.integers(0, 9, len(starts)).astype(np.uint64)
    whole = site_lines._hashed(data, starts, 0, salt)
    monkeypatch.setattr(site_lines, "PART_BYTES", 100)
    assert (site_lines._hashed(data, starts, 0, salt) == whole).all()
