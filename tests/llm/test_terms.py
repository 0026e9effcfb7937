import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from heddle.llm import terms

SCHEMA = "segment_id bigint, term string, doc_ids array<bigint>, frequencies array<int>, df int, block string"


def make(seed: int, wide: bool):
    rng, rows = random.Random(seed), []
    spread = 300_000 if wide else 30  # wide: records fall into several blocks
    for segment in range(6):
        for term in ["the", " The ", "coat", "SILK", "wool", "x", None, "", "  ", "é"]:
            ids = [rng.randrange(spread) * (1 if term != "x" else 7) for _ in range(rng.randrange(0, 40))]
            if ids and term == "coat":
                ids.append(ids[0])
            if term and "the" in term.lower():
                ids += list(range(0, spread, spread // 25))
            freqs = None if rng.random() < 0.2 else [rng.choice([None, 1, 2, 9]) for _ in ids][: len(ids) - (rng.random() < 0.1)]
            rows.append((segment, term, ids, freqs, 1, "clash"))
    rows += [rows[0], (9, "none", None, None, 1, ""), (9, "empty", [], [], 1, ""), (9, "nulls", [None], [3], 1, "")]
    return rows


def brute(rows):
    f = {}
    for _, term, ids, freqs, *_ in rows:
        t = (term or "").strip().lower()
        if not t:
            continue
        for k, d in enumerate(ids or []):
            if d is not None:
                v = freqs[k] if freqs is not None and k < len(freqs) and freqs[k] is not None else 1
                f[t, d] = max(f.get((t, d), 0), v)
    return f


@pytest.mark.parametrize("wide", [False, True])
def test_marks_and_best_terms(spark, wide):
    rows = make(1, wide)
    index = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pairs = brute(rows)
    df, docs = defaultdict(int), {d for _, d in pairs}
    for t, _ in pairs:
        df[t] += 1
    got = {r.term: r for r in terms.term_marks(index).collect()}
    assert {t: r.df for t, r in got.items()} == df
    for t, r in got.items():
        assert r.mark == ("rare" if df[t] < 3 else "common" if 5 * df[t] > len(docs) else None)
        assert r.occurrences == sum(v for (x, _), v in pairs.items() if x == t) and r.n_docs == len(docs)
    best = {}
    for (t, d), v in pairs.items():
        key = (-round(v * math.log(len(docs) / df[t]), 6), t.encode())
        best[d] = min(best.get(d, key), key)
    found = terms.distinctive_terms(index).collect()
    assert {r.doc_id: r.term.encode() for r in found} == {d: k[1] for d, k in best.items()}
    assert len(found) == len(docs)


def test_small_batches_keep_open_runs(spark):
    rows = make(2, True)
    index = spark.createDataFrame(rows, SCHEMA).repartition(2)
    whole = sorted(map(tuple, terms.term_counts(terms.posting_runs(index)).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(tuple, terms.term_counts(terms.posting_runs(index)).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_weights(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert terms.term_marks(empty).count() == terms.distinctive_terms(empty).count() == terms.weighted_terms(empty).count() == 0
    one = spark.createDataFrame([(1, "a", [1], None, 1, "")], SCHEMA)
    assert [tuple(r) for r in terms.distinctive_terms(one).collect()] == [(1, "a", 0.0)]
    weights = terms.weighted_terms(spark.createDataFrame(make(3, False), SCHEMA))
    norms = weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 or r.n == 0 for r in norms)


def test_sparse_ids_take_time_in_proportion(spark):
    """One row over a million sparse records, rows over few and many blocks, and one run in very many rows."""
    ids = [(k * 0x9E3779B97F4A7C15) % (1 << 60) for k in range(1_000_000)]
    few = [k << 14 for k in range(30)]
    rows = [("sparse", ids, None), ("sparse", ids[:3], [9, 9, None]), ("few", few, list(range(30))), ("few", few[::-1], None)] + [("often", [7, 8], [1, k]) for k in range(40_000)]
    df = spark.createDataFrame(rows, "term string, doc_ids array<bigint>, frequencies array<int>")
    got = {r.term: (r.df, r.occurrences) for r in terms.term_marks(df).collect()}
    assert got == {"sparse": (1_000_000, 1_000_000 + 16), "few": (30, sum(max(k, 1) for k in range(30))), "often": (2, 1 + 39_999)}
