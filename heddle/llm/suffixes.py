"""Sorted suffixes of token streams: which strings occur on several distinct pages of a host.

The stream of a page is a sequence of symbols, and every place in it begins a suffix. Suffixes are put in order by a
range-partitioned sort of their first ``DEPTH`` symbols; in the sorted order the suffixes that share a prefix are
neighbours, and one scan finds for each suffix its longest prefix that at least a given number of distinct pages hold.
A longer repeated string shows as a chain of suffixes that each reach beyond the next one's beginning.

Symbols hold their host, so suffixes of different hosts never share a prefix. The page is the last part of the order:
a prefix that stands on a third of all pages is spread over many tasks. What a task cannot decide alone, because the
run goes on in its neighbour, it hands on as edge rows - those that lack pages, and as many witnesses as are needed -,
which are few for each task and are decided in a second, small scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heddle.session import write_stage

#: Symbols of a suffix that are put in order.
DEPTH = 3
#: Rows scanned at once.
STEP = 1 << 18

_SUFFIX = "s1 bigint, rest bigint, page bigint, place bigint, at int"
_RUN = "place bigint, at int, depth int, s1 bigint, rest bigint, page bigint, sent boolean"
_RUN_ARROW = pa.schema([("place", pa.int64()), ("at", pa.int32()), ("depth", pa.int32()), ("s1", pa.int64()), ("rest", pa.int64()), ("page", pa.int64()), ("sent", pa.bool_())])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _suffixes(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(rows, batches)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        symbols = batch.column("symbols")
        sizes = symbols.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        s1 = symbols.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        start = np.cumsum(sizes) - sizes
        at = np.arange(len(row)) - start[row]
        place, page = (batch.column(c).to_numpy()[row] for c in ("place", "page"))
        rest = np.zeros(len(s1), np.uint64)
        for k, shift in ((1, 0), (2, 32))[: depth - 1]:
            # behind the stream's end stands what no other stream has
            follow = ((place.view(np.uint64) * _MIX >> np.uint64(7)) + at.astype(np.uint64) * np.uint64(DEPTH) + np.uint64(k)) * _MIX
            inside = np.flatnonzero(at + k < sizes[row])
            follow[inside] = s1.view(np.uint64)[inside + k]
            rest |= (follow >> np.uint64(32)) << np.uint64(32 - shift)
        return pa.RecordBatch.from_arrays([pa.array(s1), pa.array(rest.view(np.int64)), pa.array(page), pa.array(place), pa.array(at.astype(np.int32))], names=["s1", "rest", "page", "place", "at"])

    return run


class _Rows:
    """Sorted suffixes as columns; ``sent`` tells that a row is only kept as a witness."""

    def __init__(self, s1, rest, page, place, at, sent):
        self.columns = (s1, rest, page, place, at, sent)
        self.s1, self.rest, self.page, self.place, self.at, self.sent = self.columns

    def __len__(self) -> int:
        return len(self.s1)

    def take(self, which: np.ndarray) -> _Rows:
        return _Rows(*(c[which] for c in self.columns))

    @staticmethod
    def joined(parts: list[_Rows]) -> _Rows:
        return _Rows(*(np.concatenate(c) for c in zip(*(p.columns for p in parts))))

    def keys(self, depth: int) -> list[np.ndarray]:
        return [[self.s1], [self.s1, self.rest >> 32], [self.s1, self.rest]][depth - 1]

    def groups(self, depth: int) -> np.ndarray:
        change = np.zeros(len(self), bool)
        for k in self.keys(depth):
            change[1:] |= k[1:] != k[:-1]
        return np.cumsum(change)

    def common(self, of: tuple[int, int]) -> np.ndarray:
        """How many symbols each row shares with the one that begins with ``of``."""
        a = self.s1 == of[0]
        b = a & (self.rest >> 32 == of[1] >> 32)
        return a.astype(np.int8) + b + (b & (self.rest == of[1]))

    def depths(self, least: int, most: int) -> np.ndarray:
        """Of each row its longest prefix, at most ``most`` symbols, on at least ``least`` distinct pages."""
        out = np.zeros(len(self), np.int8)
        rows = np.arange(len(self))
        for depth in range(1, most + 1):
            part = self.take(rows) if len(rows) < len(self) else self
            g = part.groups(depth)
            rows, g, page = (x[np.bincount(g)[g] >= least] for x in (rows, g, part.page)) if len(g) else (rows, g, part.page)
            if not len(rows):
                break
            order = np.lexsort((page, g))
            head = np.ones(len(order), bool)
            head[1:] = (g[order][1:] != g[order][:-1]) | (page[order][1:] != page[order][:-1])
            pages = np.bincount(g[order][head], minlength=int(g[-1]) + 1)
            rows = rows[pages[g] >= least]
            out[rows] = depth
        return out


def _witnesses(rows: _Rows, of: tuple[int, int], least: int, most: int) -> np.ndarray:
    """For each prefix of a suffix rows of at most ``least`` distinct pages that begin with it."""
    shared, out = rows.common(of), []
    for depth in range(1, most + 1):
        has = np.flatnonzero(shared >= depth)
        _, first = np.unique(rows.page[has], return_index=True)
        out.append(has[first[:least]])
    return np.concatenate(out)


def _scan(least: int, most: int, edges: bool, at_once: int):
    """With ``edges`` the first and last runs go on in other tasks, and what is open of them comes out without depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[_Rows] = []
        size, first, held = 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("s1", "rest", "page", "place", "at")]
            sent = batch.column("sent").to_numpy(zero_copy_only=False) if "sent" in batch.schema.names else np.zeros(batch.num_rows, bool)
            waiting.append(_Rows(*columns, sent))
            size += batch.num_rows
            if first is None and edges:
                first = int(columns[0][0]), int(columns[1][0])
            if size >= at_once + 2 * held:
                out, left = step(_Rows.joined(waiting), first, False)
                yield out
                waiting, size = [left], len(left)
                held = size
        if waiting:
            out, left = step(_Rows.joined(waiting), first, True)
            yield out
            if edges and len(left):
                yield rows_out(left, None)

    def step(rows: _Rows, first: tuple[int, int] | None, end: bool) -> tuple[pa.RecordBatch, _Rows]:
        depth = rows.depths(least, most)
        open_to = rows.common(first) if first is not None else np.zeros(len(rows), np.int8)
        last = int(rows.s1[-1]), int(rows.rest[-1])
        borders = [first] if first is not None else []
        if edges or not end:
            open_to = np.maximum(open_to, rows.common(last))
            borders.append(last)
        final = depth >= np.minimum(open_to, most)
        sent = rows.sent | final
        done = rows.take(np.flatnonzero(final & ~rows.sent & (depth > 0)))
        out = rows_out(done, depth[final & ~rows.sent & (depth > 0)])
        keep = ~final
        for border in borders:
            keep[_witnesses(rows, border, least, most)] = True
        return out, _Rows(*rows.columns[:5], sent).take(np.flatnonzero(keep))

    def rows_out(rows: _Rows, depth: np.ndarray | None) -> pa.RecordBatch:
        n = len(rows)
        key = [pa.nulls(n, pa.int64())] * 3 if depth is not None else [pa.array(x) for x in (rows.s1, rows.rest, rows.page)]
        depths = pa.nulls(n, pa.int32()) if depth is None else pa.array(depth.astype(np.int32))
        flag = pa.nulls(n, pa.bool_()) if depth is not None else pa.array(rows.sent)
        return pa.RecordBatch.from_arrays([pa.array(rows.place), pa.array(rows.at.astype(np.int32)), depths, *key, flag], schema=_RUN_ARROW)

    return run


def repeated_prefixes(streams: DataFrame, least_pages: int, at_once: int = STEP, most: int = DEPTH) -> DataFrame:
    """(place, at, depth): the suffixes with a prefix of ``depth`` symbols, at most ``most`` (up to ``DEPTH``), on ``least_pages`` pages.

    ``streams`` has place (which identifies a stream), page and symbols (array of bigint). Only distinct pages count,
    so a stream or page that is given twice repeats nothing. Suffixes without such a prefix have no row; one at
    the border of two tasks may have a second row of less depth. ``at_once`` rows are scanned at once.
    """
    order = ["s1", "rest", "page"]
    suffixes = streams.select("place", "page", "symbols").mapInArrow(_suffixes(most), _SUFFIX)
    scanned = write_stage(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan(least_pages, most, True, at_once), _RUN), "suffix-runs")
    open_rows = scanned.where("depth IS NULL").drop("depth").repartition("s1").sortWithinPartitions(*order)
    closed = open_rows.mapInArrow(_scan(least_pages, most, False, at_once), _RUN)
    return scanned.where("depth IS NOT NULL").select("place", "at", "depth").unionByName(closed.select("place", "at", "depth"))
