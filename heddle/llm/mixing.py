"""Mixing sources to target shares of all tokens, by cube-method balanced sampling.

A source that is to give ``take`` of its ``tokens`` is repeated whole ``take // tokens`` times; of the rest every document
has the same inclusion probability. The cube method decides which: it moves the probabilities of three documents at a
time along the direction that leaves both the expected tokens and the expected number of documents unchanged, until one of them
is 0 or 1. Documents are balanced in blocks of bounded size; the at most two undecided ones of each block are balanced
again in blocks of the next level, until each source has only its landing problem of at most two documents left.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.site_lines import source_key
from heddle.session import write_stage

#: Documents that are balanced at once.
BLOCK = 20_000
#: Times the mean length from which a document is decided before the others.
LONG = 4
MOST_SOURCES = 100_000
_EPS = 1e-9


def flight(tokens: list[int], chances: list[float], rng: random.Random) -> list[float]:
    """Moves probabilities to 0 or 1 until at most two are left in between; sums of tokens and of documents are kept
    (documents of equal length change places with each other alone)."""
    out = list(chances)
    active: list[int] = []
    for k in range(len(out)):
        if _EPS < out[k] < 1 - _EPS:
            active.append(k)
        while len(active) >= 3 or len(active) == 2 and tokens[active[0]] == tokens[active[1]]:
            three = active[:3]
            t = [tokens[x] for x in three]
            if len(three) == 2:
                u = [1.0, -1.0]
            else:
                u = [float(t[1] - t[2]), float(t[2] - t[0]), float(t[0] - t[1])]
                if not any(u):
                    u = [1.0, -1.0, 0.0]
            up = min(((1 - out[x]) / v if v > 0 else -out[x] / v) for x, v in zip(three, u) if v)
            down = min((out[x] / v if v > 0 else (out[x] - 1) / v) for x, v in zip(three, u) if v)
            step = up if rng.random() * (up + down) < down else -down
            for x, v in zip(three, u):
                out[x] = min(1.0, max(0.0, out[x] + step * v))
                if out[x] < _EPS:
                    out[x] = 0.0
                elif out[x] > 1 - _EPS:
                    out[x] = 1.0
            active = [x for x in active if 0 < out[x] < 1]
    return out


def landing(tokens: list[int], chances: list[float], wanted: float | None = None) -> list[float]:
    """Decides the few undecided documents: the choice whose tokens come closest to the expected (or wanted) ones."""
    open_ = [k for k, c in enumerate(chances) if 0 < c < 1]
    wanted = sum(tokens[k] * chances[k] for k in open_) if wanted is None else wanted
    best = min(range(1 << len(open_)), key=lambda bits: (abs(sum(tokens[k] for j, k in enumerate(open_) if bits >> j & 1) - wanted), bits))
    out = list(chances)
    for j, k in enumerate(open_):
        out[k] = float(best >> j & 1)
    return out


def balance(tokens: list[int], chances: list[float], rng: random.Random) -> list[float]:
    """``flight``, with documents far longer than the mean decided first: what rounding the last of them adds or takes
    is made up for by the chances of the others, so that no long document is left for the landing."""
    n = len(tokens)
    mean = sum(tokens) / max(1, n)
    long = [k for k in range(n) if tokens[k] > LONG * mean]
    short = [k for k in range(n) if tokens[k] <= LONG * mean and 0 < chances[k] < 1]
    room = sum(tokens[k] for k in short)
    if not long or not room:
        return flight(tokens, chances, rng)
    out = list(chances)
    t = [tokens[k] for k in long]
    moved = 0.0
    for k, c in zip(long, landing(t, flight(t, [chances[k] for k in long], rng))):
        moved += tokens[k] * (c - chances[k])
        out[k] = c
    for k in short:
        out[k] = min(1.0, max(0.0, chances[k] - moved / room))
    t = [tokens[k] for k in short]
    for k, c in zip(short, flight(t, [out[k] for k in short], rng)):
        out[k] = c
    return out


def _balanced(seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n_tokens", "copy_no"])
        rng = random.Random(f"{seed}/{key[0]}/{key[1]}")
        rows["chance"] = balance(rows["n_tokens"].tolist(), rows["chance"].tolist(), rng)
        return rows

    return run


def _landed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "n_tokens", "copy_no"])
    rng = random.Random(f"landing/{key[0]}")
    rows["chance"] = landing(rows["n_tokens"].tolist(), flight(rows["n_tokens"].tolist(), rows["chance"].tolist(), rng))
    return rows


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, wanted, take): what each target source is to give.

    ``wanted`` is its share of ``total_tokens`` (by default all tokens of the target sources), ``take`` what the cap on
    repeats leaves of that; where a source is short of its target the others are not raised above theirs. Sources are
    compared trimmed and lower-cased; of repeated targets the greatest share counts, a null cap is 1.
    """
    t = targets.where("source IS NOT NULL AND target_share >= 0").groupBy(source_key(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    have = sizes.where("n_tokens > 0 AND source IS NOT NULL").groupBy(source_key(F.col("source")).alias("source")).agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    rows = t.join(have, "source", "left").fillna(0, ["documents", "tokens"])
    total = F.lit(total_tokens).cast("double") if total_tokens is not None else rows.agg(F.sum("tokens").cast("double").alias("total")).scalar()
    wanted = F.col("target_share") * total
    return rows.withColumn("wanted", wanted).withColumn("take", F.least(F.col("wanted"), F.col("tokens").cast("double") * F.greatest(F.col("max_repeats"), F.lit(0))))


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    The mix is (source, doc_id, n_tokens, copies), one row per document that is in it; ``sizes`` has doc_id, source and
    n_tokens. Documents without tokens or outside the target sources are not in it. The report has each target source
    with its tokens, target and actual share and whether the target was out of reach.
    """
    plans = write_stage(plan(sizes, targets, total_tokens), "plan")  # one row per target source
    if plans.count() > MOST_SOURCES:
        raise ValueError(f"targets are meant to be written by hand: at most {MOST_SOURCES} sources")
    keyed = sizes.where("n_tokens > 0 AND source IS NOT NULL").select(source_key(F.col("source")).alias("source"), "doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    # a document given twice is two documents
    keyed = keyed.groupBy("source", "doc_id", "n_tokens").agg(F.count("*").alias("given"))
    keyed = keyed.select("source", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("given").cast("int"))).alias("copy_no"))
    parts = plans.where("tokens > 0 AND take > 0").select("source", F.floor(F.col("take") / F.col("tokens")).cast("int").alias("whole"), (F.col("take") / F.col("tokens") - F.floor(F.col("take") / F.col("tokens"))).alias("chance"), "documents")
    rows = keyed.join(F.broadcast(parts), "source")  # at most MOST_SOURCES rows
    blocks = F.greatest(F.lit(1), F.ceil(F.col("documents") / block)).cast("bigint")
    part = F.pmod(F.xxhash64("doc_id", "copy_no", F.lit(seed)), blocks)
    schema = "source string, doc_id bigint, n_tokens bigint, copy_no int, whole int, chance double, block bigint"
    level = rows.select("source", "doc_id", "n_tokens", "copy_no", "whole", "chance", part.alias("block"))
    level = write_stage(level.groupBy("source", "block").applyInPandas(_balanced(seed), schema), "flight-0")
    decided = [level.where("chance IN (0, 1)")]
    left = level.where("chance NOT IN (0, 1)")
    for depth in range(1, 64):
        most = left.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= block:
            break
        blocks = max(1, -(-most // block))
        again = left.withColumn("block", F.pmod(F.xxhash64("doc_id", "copy_no", F.lit(seed + depth)), F.lit(blocks)))
        level = write_stage(again.groupBy("source", "block").applyInPandas(_balanced(seed + depth), schema), f"flight-{depth}")
        decided.append(level.where("chance IN (0, 1)"))
        left = level.where("chance NOT IN (0, 1)")
    decided.append(left.groupBy("source").applyInPandas(_landed, schema))
    all_rows = decided[0]
    for d in decided[1:]:
        all_rows = all_rows.unionByName(d)
    copies = F.col("whole") + F.col("chance").cast("int")
    mixed = write_stage(all_rows.groupBy("source", "doc_id", "n_tokens").agg(F.sum(copies).cast("int").alias("copies")).where("copies > 0"), "mix")
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_documents"))
    total = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).scalar()
    report = plans.join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_documents"])
    report = report.select("source", "target_share", "max_repeats", "documents", "tokens", "mixed_documents", "mixed_tokens", F.coalesce(F.col("mixed_tokens") / total, F.lit(0.0)).alias("actual_share"), (F.col("take") < F.col("wanted")).alias("out_of_reach"))
    return mixed, report
