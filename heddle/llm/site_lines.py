"""Lines and stretches of text that one source repeats under many of its documents, found by content-defined chunks.

A document's normalised text is cut by a rolling hash: a cut falls after every byte at which the hash of the last
``WINDOW`` bytes has ``CUT_BITS`` zero bits. Line ends are no cuts, so that equal stretches of text are cut alike
wherever they stand, in texts with or without line ends. Distinct documents are counted per source and chunk
(``suffixes``, with one symbol a suffix).

* Runs of chunks in many documents are cut out of the texts (``without_repeated_text``).
* A line is a candidate if every chunk whose two cuts the line itself decides is repeated; the candidates' whole lines are
  checked exactly (``repeated_lines``). Lines too short to hold such a chunk are left to the exact check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.suffixes import repeated_prefixes
from heddle.session import spread, write_stage

WINDOW, CUT_BITS = 12, 5
#: Bytes hashed at once; a longer single text is hashed whole.
STEP_BYTES = 1 << 20
#: Bytes of a longer text whose chunks are hashed at once.
PART_BYTES = 1 << 22

_RNG = np.random.default_rng(20240229)
_GEAR = _RNG.integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_BYTE = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_LISTS = {"symbols": pa.int64(), "words": pa.int32(), "letters": pa.int32(), "line_no": pa.int32(), "first": pa.int32(), "inner": pa.int32(), "line_a": pa.int64(), "line_b": pa.int64()}
_CHUNKED = "place bigint, page bigint, symbols array<bigint>, words array<int>, letters array<int>, line_no array<int>, first array<int>, inner array<int>, line_a array<bigint>, line_b array<bigint>"
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")


def source_key(source: Column) -> Column:
    return F.lower(F.trim(source, F.lit(" \t\r\n ")))


def normal_text(text: Column) -> Column:
    """The text lower-cased, each run of digits one 0, each other run of neither letters nor digits one blank, each
    line trimmed; lines stay apart at the newline character."""
    t = F.regexp_replace(F.lower(text), r"\p{Nd}+", "0")
    t = F.regexp_replace(t, r"[^\p{L}\p{Nd}\n]+", " ")
    return F.trim(F.regexp_replace(t, r" ?\n ?", "\n"), F.lit(" "))


def _hashed(data: np.ndarray, starts: np.ndarray, which: int, salt: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches of ``data`` that begin at ``starts`` and end where the next begins.

    Long data are hashed in parts that end with a stretch, so that memory is needed for one part.
    """
    half = int(np.searchsorted(starts, len(data) // 2))
    if len(data) > PART_BYTES and 0 < half < len(starts):
        at = int(starts[half])
        return np.concatenate([_hashed(data[:at], starts[:half], which, salt[:half]), _hashed(data[at:], starts[half:] - at, which, salt[half:])])
    sizes = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _BASE[which]), dtype=np.uint64)
    h = np.add.reduceat(_BYTE[which][data] * powers[place], starts)
    h = (h ^ salt ^ sizes.astype(np.uint64)) * _MIX
    return (h ^ (h >> np.uint64(31))) * _BASE[which]


def _lists(of: np.ndarray, values: np.ndarray, docs: int, kind: pa.DataType) -> pa.Array:
    offsets = np.append(0, np.cumsum(np.bincount(of, minlength=docs))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def _chunks_of(places: np.ndarray, doc_ids: np.ndarray, salts: np.ndarray, data: np.ndarray, ends: np.ndarray, least_letters: int) -> pa.RecordBatch:
    """Chunks and lines of consecutive texts; each text is ended by one newline byte at ``ends``.

    Of each chunk: symbol, twice the words that begin in it (one more if it ends within a word), letters. Of each line
    of ``least_letters`` letters: number, first and number of the chunks that it decides, two fingerprints.
    """
    docs = len(ends)
    newline = data == 10
    begins = np.append(0, ends[:-1] + 1)
    text = np.repeat(np.arange(docs, dtype=np.int32), ends + 1 - begins)  # of each byte
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    place = np.arange(len(data), dtype=kind) - begins.astype(kind)[text]
    rolled = np.zeros(len(data), np.uint32)
    for k in range(WINDOW):
        rolled[k:] += _GEAR[data[: len(data) - k]] << np.uint32(k)
    cut = ((rolled >> np.uint32(32 - CUT_BITS)) == 0) & (place >= WINDOW - 1)
    stop = cut.copy()
    stop[ends] = True
    stops = np.flatnonzero(stop)
    starts = np.append(0, stops[:-1] + 1)
    symbols = _hashed(data, starts, 0, salts[text[starts]])
    gap = newline | (data == 32)
    word = ~gap & np.append(True, gap[:-1])
    letter = ((data & 0xC0) != 0x80) & (data != 0x30) & ~gap
    within = ~gap[stops] & ~np.append(gap[1:], True)[stops]
    words, letters = np.add.reduceat(word.astype(np.int32), starts), np.add.reduceat(letter.astype(np.int32), starts)
    # lines
    line_stops = np.flatnonzero(newline)
    line_starts = np.append(0, line_stops[:-1] + 1)
    of = text[line_stops]
    first_line = np.searchsorted(of, np.arange(docs))
    number = np.arange(len(of)) - first_line[of] + 1
    long = np.add.reduceat(letter.astype(np.int32), line_starts) >= least_letters
    b, e, of, number = line_starts[long], line_stops[long], of[long], number[long]
    cuts = np.cumsum(stop, dtype=kind)  # of each byte: chunks that end up to here
    first = cuts[np.minimum(b + WINDOW - 2, e - 1)]  # the chunk of the line's first own cut
    real = np.append(kind(0), np.cumsum(cut, dtype=kind))
    inner = np.maximum(real[e] - real[np.minimum(b + WINDOW - 1, e)] - 1, 0)
    first_chunk = np.searchsorted(text[stops], np.arange(docs))
    keep = np.zeros(len(data), np.int8)
    np.add.at(keep, b, 1)
    np.add.at(keep, e, -1)
    kept = data[np.cumsum(keep, dtype=np.int8) > 0]
    at = np.append(0, np.cumsum(e - b)[:-1]).astype(np.int64)
    a, c = (_hashed(kept, at, k, salts[of]).view(np.int64) if len(of) else np.zeros(0, np.int64) for k in (0, 1))
    chunk_of = text[stops]
    by = {"symbols": (chunk_of, symbols.view(np.int64)), "words": (chunk_of, 2 * words + within), "letters": (chunk_of, letters)}
    by |= {"line_no": (of, number), "first": (of, first + 1 - first_chunk[of]), "inner": (of, inner), "line_a": (of, a), "line_b": (of, c)}
    lists = [_lists(x, v.astype(_LISTS[n].to_pandas_dtype()), docs, _LISTS[n]) for n, (x, v) in by.items()]
    return pa.RecordBatch.from_arrays([pa.array(places), pa.array(doc_ids), *lists], names=["place", "page", *_LISTS])


def _chunker(least_letters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ids, salts = (batch.column(k).to_numpy() for k in range(3))
            texts = batch.column(3).cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
            raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES)) - 1)
                yield _chunks_of(places[at:to], ids[at:to], salts.view(np.uint64)[at:to], raw[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at] - 1, least_letters)
                at = to

    return run


def _place(docs: DataFrame) -> Column:
    return F.xxhash64(F.col("doc_id").cast("bigint"), "text")


def chunked(docs: DataFrame, least_letters: int = 20) -> DataFrame:
    """(place, page, and of the chunks and of the lines with at least ``least_letters`` letters the lists of ``_CHUNKED``).

    ``docs`` has doc_id, source and text. Texts that are null and documents without id or source have no row.
    Symbols and fingerprints hold the source, so equal chunks and lines of two sources differ.
    """
    source = source_key(F.col("source"))
    # trailing newline: one per text, so that every line has an end
    ready = docs.where("text IS NOT NULL AND doc_id IS NOT NULL AND source IS NOT NULL").select(_place(docs).alias("place"), F.col("doc_id").cast("bigint").alias("page"), F.xxhash64(source).alias("salt"), F.concat(normal_text(F.col("text")), F.lit("\n")).alias("t"))
    return spread(ready).mapInArrow(_chunker(least_letters), _CHUNKED)


def _marked(docs: DataFrame, least_documents: int, least_letters: int) -> DataFrame:
    """``chunked`` without symbols, with ``often``: the places of the chunks in ``least_documents`` documents of the source."""
    chunks = write_stage(chunked(docs, least_letters), "chunks")
    often = repeated_prefixes(chunks, least_documents, most=1).groupBy("place").agg(F.collect_set("at").alias("often"))
    return chunks.drop("symbols").join(often, "place", "left")


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Row of each value of a list column, and the values."""
    column = batch.column(name)
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(n)), n), column.flatten().to_numpy(zero_copy_only=False)


def _hits(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each chunk is repeated, its text, and the first chunk of each text."""
    of, _ = _flat(batch, "words")
    first = np.searchsorted(of, np.arange(batch.num_rows + 1))
    row, at = _flat(batch, "often")
    hit = np.zeros(len(of), bool)
    hit[first[row] + at] = True
    return hit, of, first


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines whose own chunks are all repeated."""
    for batch in batches:
        hit, _, first_chunk = _hits(batch)
        total = np.append(0, np.cumsum(hit))
        of, number = _flat(batch, "line_no")
        first, inner, a, b = (_flat(batch, c)[1] for c in ("first", "inner", "line_a", "line_b"))
        begin = np.minimum(first_chunk[of] + first, len(hit))
        good = (inner == 0) | (total[np.minimum(begin + inner, len(hit))] - total[begin] == inner)
        doc = batch.column("page").to_numpy()[of]
        yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (doc, number, a, b)], names=["doc_id", "line_no", "line_a", "line_b"])


def repeated_lines(docs: DataFrame, least_documents: int = 4, least_letters: int = 20) -> DataFrame:
    """(doc_id, line_no, n_docs): lines that occur in at least ``least_documents`` distinct documents of their source.

    Lines are numbered from 1 after cutting at the newline character. A document that is given twice counts once.
    """
    candidates = write_stage(_marked(docs, least_documents, least_letters).mapInArrow(_candidates, "doc_id bigint, line_no int, line_a bigint, line_b bigint"), "candidates")
    exact = candidates.select("line_a", "line_b", "doc_id").distinct().groupBy("line_a", "line_b").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least_documents)
    return candidates.join(exact, ["line_a", "line_b"]).select("doc_id", "line_no", "n_docs").distinct()


def without_repeated_lines(docs: DataFrame, least_documents: int = 4, least_letters: int = 20) -> DataFrame:
    """``docs`` with the repeated lines of each source cut out of ``text``, and ``lines_cut``. Other columns stay."""
    cut = repeated_lines(docs, least_documents, least_letters).groupBy("doc_id").agg(F.collect_set("line_no").alias("_cut"))
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.coalesce(F.array_contains("_cut", i + 1), F.lit(False)))
    return docs.join(cut, "doc_id", "left").withColumn("text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).withColumn("lines_cut", F.coalesce(F.size("_cut"), F.lit(0))).drop("_cut")


def _stretches(least_letters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(place, from_word, to_word): runs of repeated chunks with at least ``least_letters`` letters."""
        for batch in batches:
            hit, of, first = _hits(batch)
            words, letters = _flat(batch, "words")[1].astype(np.int64), np.append(0, np.cumsum(_flat(batch, "letters")[1]))
            begun = np.append(0, np.cumsum(words >> 1))
            joined = np.append(False, hit[:-1] & (of[1:] == of[:-1])) if len(of) else hit
            begin = np.flatnonzero(hit & ~joined)
            end = np.flatnonzero(hit & ~np.append(joined[1:] & hit[1:], False)) + 1 if len(of) else begin
            good = letters[end] - letters[begin] >= least_letters
            begin, end = begin[good], end[good]
            text = of[begin]
            out = begun[begin] - begun[first[text]], begun[end] - begun[first[text]] - (words[end - 1] & 1)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("place").to_numpy()[text]), *(pa.array(x.astype(np.int32)) for x in out)], names=["place", "from_word", "to_word"])

    return run


def _without(text: str, stretches: list[tuple[int, int]]) -> str:
    """The text without stretches of its words; what stands between two words goes with the first."""
    low = text.lower()
    place = None if len(low) == len(text) else [k for k, c in enumerate(text) for _ in c.lower()]
    starts = [m.start() for m in _WORD.finditer(low)]
    starts = (starts if place is None else [place[k] for k in starts]) + [len(text)]
    kept, at = [], 0
    for begin, end in sorted(stretches):
        if begin < end:
            kept.append(text[at : starts[min(begin, len(starts) - 1)]])
            at = starts[min(end, len(starts) - 1)]
    return "".join([*kept, text[at:]])


def without_repeated_text(docs: DataFrame, least_documents: int = 4, least_letters: int = 20) -> DataFrame:
    """``docs`` with stretches of at least ``least_letters`` letters cut out of ``text`` that consist of chunks in
    ``least_documents`` documents of the source, and ``stretches_cut``. Lines play no part.

    Other columns and rows stay; texts that are null, and documents without id or source, stay as they are. At both
    ends of a repeated stretch a piece may be left that makes no whole chunk (2 ** ``CUT_BITS`` bytes on average).
    """
    cut = _marked(docs, least_documents, least_letters).mapInArrow(_stretches(least_letters), "place bigint, from_word int, to_word int").where("from_word < to_word").distinct()
    cut = cut.groupBy("place").agg(F.collect_list(F.struct("from_word", "to_word")).alias("_cut")).withColumnRenamed("place", "_place")

    @F.pandas_udf("string")
    def left(text, cuts):
        return text.combine(cuts, lambda t, c: t if t is None or c is None else _without(t, [(int(x["from_word"]), int(x["to_word"])) for x in c]))

    place = F.when(F.col("source").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull(), _place(docs))
    joined = docs.withColumn("_place", place).join(cut, "_place", "left")
    return joined.withColumn("text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(left(F.col("text"), F.col("_cut")))).withColumn("stretches_cut", F.coalesce(F.size("_cut"), F.lit(0))).drop("_cut", "_place")
