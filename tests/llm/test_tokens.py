import bisect
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import mixing, packing, splitting, tokens

SIZES = "doc_id bigint, source string, n_tokens bigint, container string, share string"


def sizes(spark, rows):
    return spark.createDataFrame([(d, s, n, "", "") for d, s, n in rows], SIZES)


def packed_is_right(rows, out, capacity):
    want = Counter()
    for d, _, n in rows:
        if n and n > 0:
            full, rest = divmod(n, capacity)
            want.update((d, k, capacity) for k in range(full))
            if rest:
                want[d, full, rest] += 1
    assert Counter((r.doc_id, r.part_no, r.n_tokens) for r in out) == want
    load = defaultdict(int)
    for r in out:
        load[r.container] += r.n_tokens
    assert all(v <= capacity for v in load.values())
    return len(load)


def best_fit(sizes, capacity):
    rooms, n = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(rooms, s)
        room = rooms.pop(at) if at < len(rooms) else capacity
        n += room == capacity
        if room > s:
            bisect.insort(rooms, room - s)
    return n


@pytest.mark.parametrize("capacity", [64, 512])
def test_pack(spark, capacity):
    rng = random.Random(capacity)
    rows = [(d, "s", rng.choice([rng.randrange(1, 40), rng.randrange(30, 700), 200])) for d in range(3000)] + [(9001, "s", 0), (9002, "s", None), (9003, "s", capacity), (9004, "s", 20 * capacity + 1), (5, "s", 100)]
    out = packing.pack(sizes(spark, rows), capacity).collect()
    used = packed_is_right(rows, out, capacity)
    whole = sum((n or 0) // capacity for _, _, n in rows)
    assert used <= 1.04 * (whole + best_fit([n % capacity for _, _, n in rows if n and n % capacity], capacity)) + 2


@pytest.mark.parametrize("rows", [[], [(1, "s", 3)], [(1, "s", 100)], [(1, "s", 64), (2, "s", 64)], [(k, "s", 40) for k in range(7)], [(k, "s", 2) for k in range(70)]])
def test_pack_few(spark, rows):
    packed_is_right(rows, packing.pack(sizes(spark, rows), 64).collect(), 64)


def test_shares_of_best_fit(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE_ROWS", 100)
    rows = [(d, "s", 1 + d % 90) for d in range(2000)]
    used = packed_is_right(rows, packing.pack(sizes(spark, rows), 100).collect(), 100)
    assert used <= 1.05 * sum(n for _, _, n in rows) / 100


def test_configurations_hold_all_items():
    rng = np.random.default_rng(1)
    for _ in range(5):
        s = np.unique(rng.integers(20, 200, 10))
        n = rng.integers(1, 300, len(s))
        plan = packing.configurations(s, n, 256)
        assert (sum(items * copies for items, copies in plan) == n).all()
        assert all((items * s).sum() <= 256 and copies > 0 for items, copies in plan)
        assert sum(c for _, c in plan) <= best_fit(np.repeat(s, n).tolist(), 256) + len(s)


def test_pack_all_and_report(spark):
    limits = spark.createDataFrame([("pack", 64, None), (" PACK", 128, None), ("split", 32, 4), ("pack", None, None)], "purpose string, size_tokens int, overlap_tokens int")
    out = packing.report(packing.pack_all(sizes(spark, [(k, "s", 30) for k in range(100)]), limits)).collect()
    assert {r.capacity: r.containers for r in out} == {64: 50, 128: 25}
    assert packing.pack_all(sizes(spark, []), limits.limit(0)).count() == 0


TARGETS = "source string, target_share double, max_repeats int"


def test_mix(spark):
    rng = random.Random(9)
    rows = [(d, rng.choice(["A", "a ", "A", "A", "b", "c", None, "other"]), rng.choice([0, 5, rng.randrange(10, 900)])) for d in range(4000)]
    targets = spark.createDataFrame([("a", 0.3, 1), ("B", 0.4, 5), ("c", 0.2, 1), ("gone", 0.1, 3), ("c", 0.1, 1), (None, 0.5, 1)], TARGETS)
    for block in (20_000, 50):
        mixed, report = mixing.mix(sizes(spark, rows), targets, block=block)
        plans = {r.source: r for r in mixing.plan(sizes(spark, rows), targets).collect()}
        got = defaultdict(int)
        for r in mixed.collect():
            got[r.source] += r.n_tokens * r.copies
            assert 1 <= r.copies <= plans[r.source].max_repeats
        for s, p in plans.items():
            assert abs(got[s] - p.take) <= 900, (s, got[s], p.take)
        shares = {r.source: r for r in report.collect()}
        assert set(shares) == {"a", "b", "c", "gone"} and shares["gone"].out_of_reach and shares["gone"].actual_share == 0
        assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9


def test_mix_keeps_the_number_of_documents(spark):
    rows = [(d, "a", 10 + d % 500) for d in range(2000)] + [(d, "b", 100) for d in range(2000, 3000)]
    mixed, _ = mixing.mix(sizes(spark, rows), spark.createDataFrame([("a", 0.2, 1)], TARGETS), total_tokens=500_000)
    n = mixed.count()
    assert abs(n / 2000 - 100_000 / sum(t for _, s, t in rows if s == "a")) < 0.002


def test_flight_keeps_sums():
    rng = random.Random(1)
    t = [rng.randrange(1, 2000) for _ in range(500)]
    p = [0.37] * 500
    out = mixing.flight(t, p, rng)
    assert sum(0 < x < 1 for x in out) <= 2
    assert abs(sum(out) - sum(p)) < 1e-6 and abs(sum(a * b for a, b in zip(t, out)) - sum(a * b for a, b in zip(t, p))) < 1e-2
    assert all(x in (0, 1) for x in mixing.landing(t, out))
    assert mixing.flight([5], [0.4], rng) == [0.4] and mixing.flight([], [], rng) == []


def test_long_documents_leave_no_gap():
    for seed in range(30):
        rng = random.Random(seed)
        t = [rng.choice([rng.randrange(50, 300)] * 30 + [rng.randrange(8_000, 20_000)]) for _ in range(800)]
        out = mixing.balance(t, [0.41] * 800, rng)
        got = sum(a * b for a, b in zip(t, mixing.landing(t, out)))
        assert abs(got - 0.41 * sum(t)) < 400


def test_mix_empty(spark):
    targets = spark.createDataFrame([("a", 0.5, 2)], TARGETS)
    mixed, report = mixing.mix(sizes(spark, []), targets)
    assert mixed.count() == 0 and report.first().mixed_tokens == 0
    mixed, report = mixing.mix(sizes(spark, [(1, "a", 5)]), targets.limit(0))
    assert mixed.count() == report.count() == 0


TEXTS = {
    1: "A first sentence here. A second one follows it! And a third?\nA new line begins.\n\nA paragraph after a gap. " * 12,
    2: "no ends at all just words in one long row " * 60,
    3: "été à la façon d'hiver – “citée”… 漢字仮名交じり文 🙂🙂🙂 " * 40,
    4: "x" * 5000,
    5: "short", 6: "", 7: None, 8: "   \n\n  ",
    9: "🙂" * 600,
    10: "a\r\nb\r\n\r\nc. d\r\n" * 80,
}


@pytest.mark.parametrize(("size", "overlap"), [(40, 0), (40, 7), (64, 16)])
def test_split(spark, size, overlap):
    docs = spark.createDataFrame([(k, v, 1, "clash") for k, v in TEXTS.items()] + [(None, TEXTS[1], 1, "")], "doc_id bigint, text string, piece_no int, piece string")
    limits = spark.createDataFrame([("split", size, overlap), ("split", size, overlap), ("pack", 10, None), ("split", None, 1)], "purpose string, size_tokens int, overlap_tokens int")
    enc, by = tokens.encoding(), defaultdict(list)
    for r in splitting.split_documents(docs, limits).collect():
        by[r.doc_id].append(r)
    for d, text in TEXTS.items():
        whole = enc.encode_ordinary(text or "")
        pieces = sorted(by[d], key=lambda r: r.piece_no)
        if len(whole) <= size:
            assert not pieces
            continue
        assert pieces[0].first_token == 0 and pieces[-1].first_token + pieces[-1].n_tokens == len(whole)
        for a, b in zip(pieces, pieces[1:]):
            shared = a.first_token + a.n_tokens - b.first_token
            assert overlap <= shared <= overlap + 4 and b.first_token > a.first_token
        for r in pieces:
            assert r.n_tokens <= size and len(enc.encode_ordinary(r.piece)) <= size and "�" not in r.piece
            if d not in (3, 4, 9):
                assert r.piece == enc.decode(whole[r.first_token : r.first_token + r.n_tokens])
    assert {r.boundary for r in by[1]} <= {"paragraph", "line", "sentence"}
    assert {r.boundary for r in by[2][:-1]} <= {"word", "paragraph"}


def test_pointer_doubling_equals_walking():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 400))
        kind = rng.integers(-1, 5, n + 1)
        kind[0] = kind[-1] = 4
        size = int(rng.integers(4, 60))
        overlap = int(rng.integers(0, size // 2))
        got = splitting.cuts(kind, size, overlap)
        at, walked = 0, []
        while True:
            if at + size >= n:
                end = n
            else:
                least, end = at + max(size // 2, overlap + 1), None
                for k in range(4, -1, -1):
                    end = next((e for e in range(at + size, least - 1, -1) if kind[e] >= k), None)
                    if end is not None:
                        break
                if end is None:
                    end = next((e for e in range(at + size, at + overlap, -1) if kind[e] >= 0), at + size)
            walked.append((at, end))
            if end >= n:
                break
            start = end - overlap
            while start > 0 and kind[start] < 0:
                start -= 1
            at = start if start > at else end
        assert got == walked


def test_sizes(spark):
    df = spark.createDataFrame([(1, "a", "silk coat", 0), (2, None, None, 0), (3, "a", "", 0), (None, "a", "x", 0)], "doc_id bigint, source string, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in tokens.sized(df).collect()}
    assert got == {1: len(tokens.encoding().encode_ordinary("silk coat")), 2: 0, 3: 0}
    assert tokens.sized(df.where(F.lit(False))).count() == 0
