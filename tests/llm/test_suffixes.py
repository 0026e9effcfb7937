import random
from collections import defaultdict

import pytest

from heddle.llm import suffixes

SCHEMA = "place bigint, page bigint, symbols array<bigint>, s1 string"


def brute(rows, least):
    pages = defaultdict(set)
    for _, page, symbols, _ in rows:
        for at in range(len(symbols)):
            for depth in range(1, suffixes.DEPTH + 1):
                if at + depth <= len(symbols):
                    pages[tuple(symbols[at : at + depth])].add(page)
    out = set()
    for place, _, symbols, _ in rows:
        for at in range(len(symbols)):
            good = [d for d in range(1, suffixes.DEPTH + 1) if at + d <= len(symbols) and len(pages[tuple(symbols[at : at + d])]) >= least]
            if good:
                out.add((place, at, max(good)))
    return out


@pytest.mark.parametrize("step", [1, 7, 1 << 18])
@pytest.mark.parametrize("least", [2, 3, 5])
def test_equals_brute_force(spark, step, least):
    """One symbol stands on nearly all pages, so that its run goes over several tasks and steps."""
    rng = random.Random(step + least)
    symbol = lambda: 5 << 40 if rng.random() < 0.4 else (rng.randrange(30) + 9) << 40
    rows = [(k, rng.randrange(60), [symbol() for _ in range(rng.randrange(12))], "clash") for k in range(80)]
    rows += [(1000, 61, [5 << 40] * 500, "one page over and over"), rows[0], (1001, 62, None, ""), (1002, 63, [], "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.place, r.at, r.depth) for r in suffixes.repeated_prefixes(df, least, step).collect()}
    best = {}
    for place, at, depth in got:  # a row of several tasks' borders may come out with less before it comes out with all
        best[place, at] = max(depth, best.get((place, at), 0))
    assert {(*k, d) for k, d in best.items()} == brute([(p, g, s or [], c) for p, g, s, c in rows], least)


def test_empty(spark):
    assert suffixes.repeated_prefixes(spark.createDataFrame([], SCHEMA), 3).count() == 0
