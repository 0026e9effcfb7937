"""Corpus-wide term counts and term distinctiveness over inverted-index segments.

Both start from one operator, ``posting_runs``: the (term, record) pairs are put in order by a range-partitioned
external sort and scanned in runs. A pair's sort key is (term, block of records); pairs of one key travel as one
array, so the shuffle carries about the bytes of the input, and a term that occurs in a third of all records is
spread over many blocks and thereby over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.session import spread, write_stage

#: Records of one block: bounds what the scan holds at once.
BLOCK = 1 << 16
#: Blocks of one row up to which its pairs travel in one array for each block; in rows over more each pair travels alone.
ROW_BLOCKS = 8
#: Rows of one run that are held before repeated pairs among them are merged.
HELD_ROWS = 1 << 14
#: Pairs reduced at once when the best term of each record is looked for.
REDUCE_PAIRS = 1 << 20

_BLANKS = " \t\n\r\f\v\u00a0"
_RUNS = pa.schema([("term", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("occurrences", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("freqs", pa.list_(pa.int32()))])


def clean_term(term: Column) -> Column:
    """Lower-cased and freed of outer blanks; null where nothing is left."""
    t = F.lower(F.trim(term, F.lit(_BLANKS)))
    return F.when(t != "", t)


def _blocked(index: DataFrame) -> DataFrame:
    """Rows (term, block, doc_ids, freqs), still unsorted: index rows over several blocks are cut at the borders.

    Most rows lie in one block and keep their arrays as they are; nulls are left to the scan. Cutting looks at each
    pair once for each of at most ``ROW_BLOCKS`` blocks; a row over more, as sparse or hashed ids make them, is cut into
    its pairs. The work is thus in proportion to the pairs.
    """
    block = lambda d: F.floor(d / F.lit(BLOCK)).cast("bigint")
    rows = index.select(clean_term(F.col("term")).alias("term"), "doc_ids", F.col("frequencies").cast("array<int>").alias("f"), block(F.array_min("doc_ids")).alias("lo"), block(F.array_max("doc_ids")).alias("hi"))
    rows = rows.where(F.col("term").isNotNull() & F.col("hi").isNotNull())
    piece = lambda b, d, f: F.struct(b.alias("block"), d.alias("doc_ids"), f.alias("freqs"))
    # arrays_zip pads the shorter array with nulls
    pairs = F.filter(F.arrays_zip(F.col("doc_ids").alias("d"), F.coalesce("f", F.array().cast("array<int>")).alias("f")), lambda x: x["d"].isNotNull())
    inside = lambda b: F.filter(pairs, lambda x: block(x["d"]) == b)
    blocks = F.array_distinct(F.transform(pairs, lambda x: block(x["d"])))
    cut = F.transform(blocks, lambda b: piece(b, F.transform(inside(b), lambda x: x["d"]), F.transform(inside(b), lambda x: x["f"])))
    single = F.transform(pairs, lambda x: piece(block(x["d"]), F.array(x["d"]), F.array(x["f"])))
    return rows.select("term", F.inline(F.when(F.col("lo") == F.col("hi"), F.array(piece(F.col("lo"), F.col("doc_ids"), F.col("f")))).when(F.size(blocks) <= ROW_BLOCKS, cut).otherwise(single)))


def _pairs(docs: pa.ListArray, freqs: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, record, frequency) of each record that is not null; a frequency that is missing or null is 1."""
    n, m = (x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (docs, freqs))
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    there = place < m[row]
    given = freqs.flatten().fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64)
    f = np.ones(len(row), np.int64)
    f[there] = given[((np.cumsum(m) - m)[row] + place)[there]]
    flat = docs.flatten()
    if flat.null_count:
        good = flat.is_valid().to_numpy(zero_copy_only=False)
        return row[good], flat.drop_null().to_numpy(zero_copy_only=False), f[good]
    return row, flat.to_numpy(zero_copy_only=False), f


def _scan(keep_pairs: bool):
    """Run-length scan of sorted rows: one output row per (term, block), repeated pairs merged."""

    def merged(terms: pa.Array, blocks: np.ndarray, group: np.ndarray, docs: np.ndarray, freqs: np.ndarray, first: np.ndarray, keep: bool) -> pa.RecordBatch:
        order = np.lexsort((-freqs, docs, group))  # the greatest frequency of a pair comes first
        group, docs, freqs = group[order], docs[order], freqs[order]
        head = np.ones(len(docs), bool)
        head[1:] = (group[1:] != group[:-1]) | (docs[1:] != docs[:-1])
        group, docs, freqs = group[head], docs[head], freqs[head]
        n = np.bincount(group, minlength=len(first)).astype(np.int64)
        occurrences = np.bincount(group, weights=freqs, minlength=len(first)).astype(np.int64)
        offsets = np.zeros(len(first) + 1, np.int32)
        if keep:
            offsets[1:] = np.cumsum(n)
        kept = slice(None) if keep else slice(0)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (docs[kept], freqs[kept].astype(np.int32))]
        return pa.RecordBatch.from_arrays([terms.take(pa.array(first)), pa.array(blocks[first]), pa.array(n), pa.array(occurrences), *lists], schema=_RUNS)

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return batch.column("term")[row].as_py(), batch.column("block")[row].as_py()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the run that is still open, put together once when it ends
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and key(batch, batch.num_rows - 1) == key(held[0], 0):
                held.append(batch)
                rows += batch.num_rows
                if rows > HELD_ROWS:
                    held = [r.select(["term", "block", "doc_ids", "freqs"]) for r in whole_run(held, True)]
                    rows = 1
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            terms = table["term"].combine_chunks()
            blocks = table["block"].to_numpy()
            codes = terms.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            head = np.ones(len(codes), bool)
            head[1:] = (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])
            first = np.flatnonzero(head)
            held = table.slice(first[-1]).to_batches()
            rows = table.num_rows - first[-1]
            if len(first) > 1:
                yield from closed(table.slice(0, first[-1]), terms, blocks, head, first[:-1], keep_pairs)
        if held:
            yield from whole_run(held, keep_pairs)

    def whole_run(held: list[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        head = np.zeros(table.num_rows, bool)
        head[0] = True
        yield from closed(table, table["term"].combine_chunks(), table["block"].to_numpy(), head, np.array([0]), keep)

    def closed(table: pa.Table, terms: pa.Array, blocks: np.ndarray, head: np.ndarray, first: np.ndarray, keep: bool) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(head[: table.num_rows]) - 1
        row, docs, freqs = _pairs(table["doc_ids"].combine_chunks(), table["freqs"].combine_chunks())
        yield merged(terms, blocks, group[row], docs, freqs, first, keep)

    return scan


def posting_runs(index: DataFrame, keep_pairs: bool = True) -> DataFrame:
    """(term, block, n, occurrences, doc_ids, freqs): the distinct (term, record) pairs in sorted runs.

    ``index`` has term, doc_ids and frequencies (other columns are ignored). Rows without a term or without records
    are left out; null record ids are left out; of a pair stored more than once the greatest frequency counts and a
    missing frequency is 1. A term has several rows where its records fall into several blocks.
    """
    rows = _blocked(spread(index.select("term", "doc_ids", "frequencies"))).repartitionByRange("term", "block").sortWithinPartitions("term", "block")
    return rows.mapInArrow(_scan(keep_pairs), "term string, block bigint, n bigint, occurrences bigint, doc_ids array<bigint>, freqs array<int>")


def record_count(runs: DataFrame) -> DataFrame:
    """One row: the number of distinct records of runs that keep their pairs."""
    return runs.select(F.explode("doc_ids").alias("d")).distinct().agg(F.count("*").alias("n_docs"))


def term_counts(runs: DataFrame) -> DataFrame:
    """(term, df, occurrences) from runs; blocks add up because each pair lies in exactly one."""
    return runs.groupBy("term").agg(F.sum("n").alias("df"), F.sum("occurrences").alias("occurrences"))


def term_marks(index: DataFrame, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """(term, df, occurrences, n_docs, mark) of every term: mark is 'rare' if df < rare_below, 'common' if
    df > common_above * n_docs, else null; rare goes before common. An empty index gives no rows.
    """
    runs = write_stage(posting_runs(index), "runs")
    n = record_count(runs).scalar()
    counts = term_counts(runs).withColumn("n_docs", n)
    mark = F.when(F.col("df") < rare_below, "rare").when(F.col("df") * (1 / common_above) > F.col("n_docs"), "common")
    return counts.withColumn("mark", mark)


def distinctive_terms(index: DataFrame) -> DataFrame:
    """(doc_id, term, score): of each record the term with the greatest f * ln(N / df), rounded to six decimals.

    f is the greatest frequency stored of the term in the record (1 where missing), df the number of records of the
    term, N that of all records; of equal terms the first in byte order. Every record with at least one term has a row.
    """
    runs = write_stage(posting_runs(index), "runs")
    n = record_count(runs).scalar()
    df = term_counts(runs).select("term", F.log(n / F.col("df")).alias("idf"))
    scored = runs.select("term", "doc_ids", "freqs").join(df, "term").mapInArrow(_best_of_part, "doc_id bigint, neg double, term string")
    best = scored.groupBy("doc_id").agg(F.min(F.struct("neg", "term")).alias("b"))
    return best.select("doc_id", F.col("b.term").alias("term"), (-F.col("b.neg") + F.lit(0.0)).alias("score"))


def _best_of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each record the best term within a bounded buffer of pairs; the final choice is an aggregate."""

    def reduced(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        docs = table["doc_ids"].combine_chunks()
        row = np.repeat(np.arange(table.num_rows), docs.value_lengths().to_numpy(zero_copy_only=False))
        ids = docs.flatten().to_numpy(zero_copy_only=False)
        neg = -np.round(table["freqs"].combine_chunks().flatten().to_numpy(zero_copy_only=False) * table["idf"].to_numpy()[row], 6)
        least = np.lexsort((neg, ids))
        head = np.ones(len(ids), bool)
        head[1:] = ids[least[1:]] != ids[least[:-1]]
        low = neg[least[head]][np.cumsum(head) - 1]  # each record's best score, along the order
        tied = least[neg[least] == low]
        return pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(neg[tied]), table["term"].combine_chunks().take(pa.array(row[tied]))], names=["doc_id", "neg", "term"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column("doc_ids").flatten())
        if size >= REDUCE_PAIRS:
            yield reduced(held)
            held, size = [], 0
    if held:
        yield reduced(held)


def weighted_terms(index: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, tf, df, tf_idf, weight): every pair with f * ln((1 + N) / (1 + df)) and its share of the
    record's vector length (the weights of a record have length 1; 0 where every term is in all records).
    """
    runs = write_stage(posting_runs(index), "runs")
    n = record_count(runs).scalar()
    df = term_counts(runs).select("term", "df")
    pairs = runs.select("term", F.explode(F.arrays_zip("doc_ids", "freqs")).alias("p")).select("term", F.col("p.doc_ids").alias("doc_id"), F.col("p.freqs").cast("bigint").alias("tf"))
    scored = pairs.join(df, "term").withColumn("tf_idf", F.col("tf") * F.log((1 + n) / (1 + F.col("df"))))
    norm = scored.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("tf_idf") * F.col("tf_idf"))).alias("norm"))
    return scored.join(norm, "doc_id").select("term", "doc_id", "tf", "df", "tf_idf", F.when(F.col("norm") > 0, F.col("tf_idf") / F.col("norm")).otherwise(0.0).alias("weight"))
