"""Filling containers of fixed capacity with texts of varying length, by linear grouping.

Large items are put in order of size by a range-partitioned sort, cut into groups of equal cardinality and rounded up
to their group's greatest size. For these few sizes the configurations of a container are optimised by column
generation over the linear program; whole copies of the configurations are then filled with the actual items by
arithmetic on their ranks. The small items go where they fit best, in independent shares of bounded size. What the
driver holds are the sizes' histogram and the configurations, bounded by the capacity and the number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.session import write_stage

#: Groups of the linear grouping; items of at most this share of the capacity are small.
GROUPS, SMALL_SHARE = 64, 0.125
#: Items and containers that one share of the best-fit step holds.
SHARE_ROWS = 50_000
#: Sizes that one table of limits may hold; more are an error.
MOST_SIZES = 1000


def _best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The container content of greatest value: an unbounded knapsack over the rounded sizes.

    Size by size, rooms are improved in stretches as long as the size, each from the one before; sizes are over a share
    of the capacity, so that these are few.
    """
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k in np.flatnonzero(values > 1e-12):
        s = int(sizes[k])
        for at in range(s, capacity + 1, s):
            to = min(at + s, capacity + 1)
            worth = best[at - s : to - s] + values[k]
            better = worth > best[at:to] + 1e-12
            best[at:to][better] = worth[better]
            last[at:to][better] = k
    pattern, room = np.zeros(len(sizes)), capacity
    while last[room] >= 0:
        k = last[room]
        pattern[k] += 1
        room -= int(sizes[k])
    return float(values @ pattern), pattern


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 200) -> list[tuple[np.ndarray, int]]:
    """Patterns (items per size) and their copies that hold exactly ``counts`` items of the ``sizes``."""
    k = len(sizes)
    if not k:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    need = counts.astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        worth, pattern = _best_pattern(np.ones(k) @ inverse, sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        x, d = inverse @ need, inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = pattern
    copies = np.floor(np.linalg.solve(basis, need) + 1e-9).clip(0).astype(int)
    chosen, left = [], counts.astype(int).copy()
    for column, n in zip(basis.T, copies):
        items = np.rint(column).astype(int)
        used = items > 0
        n = int(min(n, (left[used] // items[used]).min())) if used.any() else 0
        if n:
            chosen.append((items, n))
            left -= items * n
    # what rounding leaves are fewer containers than sizes: first fit, greatest first
    while left.sum():
        items, room = np.zeros(k, int), capacity
        for at in np.argsort(-sizes):
            n = min(int(left[at]), room // int(sizes[at]))
            items[at] = n
            room -= n * int(sizes[at])
        copies_now = int((left[items > 0] // items[items > 0]).min())
        chosen.append((items, copies_now))
        left -= items * copies_now
    return chosen


def _plan(histogram: list[tuple[int, int]], capacity: int, groups: int) -> tuple[np.ndarray, int]:
    """Intervals of ranks and the containers they fill, from the sizes of the large items in ascending order.

    A row is (first rank, items of one container, first container); the last column counts the containers.
    """
    n = sum(c for _, c in histogram)
    if not n:
        return np.zeros((0, 3), np.int64), 0
    tops, counts, cut, seen = [], [], [round(n * (g + 1) / groups) for g in range(groups)], 0
    sizes = np.repeat([s for s, _ in histogram], 1)
    ends = np.cumsum([c for _, c in histogram])
    for stop in sorted({c for c in cut if c > 0}):
        tops.append(int(sizes[np.searchsorted(ends, stop)]))  # the size of the last item of the group
        counts.append(stop - seen)
        seen = stop
    patterns = configurations(np.array(tops), np.array(counts), capacity)
    rows, container = [], 0
    starts = np.cumsum([0, *counts[:-1]])
    used = np.zeros(len(tops), np.int64)
    for items, copies in patterns:
        for g in np.flatnonzero(items):
            rows.append((starts[g] + used[g], items[g], container))
            used[g] += items[g] * copies
        container += copies
    return np.array(sorted(rows), np.int64), container


def _assign(intervals: np.ndarray, offsets: dict[int, int]):
    first = intervals[:, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            part = place >> 33
            rank = (place & ((1 << 33) - 1)) + np.array([offsets[p] for p in np.unique(part)])[np.searchsorted(np.unique(part), part)]
            row = intervals[np.searchsorted(first, rank, side="right") - 1]
            container = row[:, 2] + (rank - row[:, 0]) // row[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(container), batch.column("doc_id"), batch.column("part_no"), batch.column("n_tokens")], names=["container", "doc_id", "part_no", "n_tokens"])

    return run


def _best_fit(capacity: int):
    def run(key: tuple, rooms: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        """Each item, greatest first, goes into the open container with the least sufficient room."""
        share = int(key[0])
        stacks: dict[int, list[int]] = {}
        mask = 0
        for c, r in zip(rooms["container"].tolist(), rooms["room"].tolist()):
            if r > 0:
                stacks.setdefault(r, []).append(c)
                mask |= 1 << r
        items = items.sort_values(["n_tokens", "doc_id", "part_no"], ascending=[False, True, True])
        out, new = [], 0
        for size in items["n_tokens"].tolist():
            rest = mask >> size
            if rest:
                room = size + (rest & -rest).bit_length() - 1
                stack = stacks[room]
                container = stack.pop()
                if not stack:
                    mask &= ~(1 << room)
            else:
                new += 1
                room, container = capacity, -((share << 32) + new)  # below 0: containers of this share
            room -= size
            if room:
                stacks.setdefault(room, []).append(container)
                mask |= 1 << room
            out.append(container)
        return pd.DataFrame({"container": np.array(out, np.int64), "doc_id": items["doc_id"], "part_no": items["part_no"], "n_tokens": items["n_tokens"]})

    return run


def pack(sizes: DataFrame, capacity: int, groups: int = GROUPS, small_share: float = SMALL_SHARE) -> DataFrame:
    """(container, doc_id, part_no, n_tokens): every item in one container, no container over ``capacity``.

    ``sizes`` has doc_id and n_tokens, one row per item. An item within the capacity is whole (part_no 0); a greater
    one is cut into parts of the capacity, each a container of its own, and a rest that is packed like other items.
    Items without tokens need no room and have no row. Container numbers are unique, not consecutive.
    """
    columns = ["container", "doc_id", "part_no", "n_tokens"]
    items = sizes.where("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("bigint").alias("n"))
    full = (F.col("n") / capacity).cast("bigint")
    parts = items.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / capacity).cast("bigint") - 1)).alias("p"), "n", full.alias("full"))
    parts = parts.select("doc_id", F.col("p").cast("int").alias("part_no"), F.when(F.col("p") < F.col("full"), F.lit(capacity)).otherwise(F.col("n") - F.col("full") * capacity).cast("bigint").alias("n_tokens"))
    limit = max(1, int(capacity * small_share))
    # a full part or item fills a container by itself; its number comes from a counter of each task
    whole = parts.where(F.col("n_tokens") == capacity).select((F.lit(1 << 62) + F.monotonically_increasing_id()).alias("container"), "doc_id", "part_no", "n_tokens")
    large = parts.where((F.col("n_tokens") > limit) & (F.col("n_tokens") < capacity))
    ordered = write_stage(large.repartitionByRange("n_tokens", "doc_id", "part_no").sortWithinPartitions("n_tokens", "doc_id", "part_no").withColumn("place", F.monotonically_increasing_id()), "ordered")
    per_part = ordered.groupBy(F.shiftright("place", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # one row per task
    offsets, seen = {}, 0
    for p, n in per_part:
        offsets[p], seen = seen, seen + n
    histogram = [(s, n) for s, n in ordered.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()]  # at most ``capacity`` rows
    intervals, containers = _plan(histogram, capacity, groups)
    placed = write_stage(ordered.mapInArrow(_assign(intervals, offsets), "container bigint, doc_id bigint, part_no int, n_tokens bigint"), "placed") if containers else None
    small = write_stage(parts.where(F.col("n_tokens") <= limit), "small")
    shares = max(1, -(-(small.count() + containers) // SHARE_ROWS))
    share = lambda *c: F.pmod(F.xxhash64(*c), F.lit(shares))
    rooms = (placed.groupBy("container").agg((F.lit(capacity) - F.sum("n_tokens")).alias("room")) if placed is not None else sizes.sparkSession.createDataFrame([], "container bigint, room bigint")).withColumn("share", share("container"))
    fitted = rooms.groupBy("share").cogroup(small.withColumn("share", share("doc_id", "part_no")).groupBy("share")).applyInPandas(_best_fit(capacity), "container bigint, doc_id bigint, part_no int, n_tokens bigint")
    out = whole.select(*columns).unionByName(fitted.select(*columns))
    return out.unionByName(placed.select(*columns)) if placed is not None else out


def pack_all(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """``pack`` for each 'pack' size of ``limits`` (purpose, size_tokens), with ``capacity``."""
    # a table by hand: its size is checked
    found = limits.where("lower(trim(purpose)) = 'pack' AND size_tokens > 0").select("size_tokens").distinct().limit(MOST_SIZES + 1).collect()
    if len(found) > MOST_SIZES:
        raise ValueError(f"limits is meant to hold at most {MOST_SIZES} sizes")
    capacities = sorted({r[0] for r in found})
    out = None
    for c in capacities:
        one = pack(sizes, c).withColumn("capacity", F.lit(c).cast("bigint"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return sizes.sparkSession.createDataFrame([], "container bigint, doc_id bigint, part_no int, n_tokens bigint, capacity bigint")
    return out


def report(packed: DataFrame) -> DataFrame:
    """(capacity, containers, items, tokens, fill): fill is the share of the containers' room that is used."""
    one = packed.groupBy("capacity", "container").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    return one.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens")).withColumn("fill", F.round(F.col("tokens") / (F.col("capacity") * F.col("containers")), 4))
