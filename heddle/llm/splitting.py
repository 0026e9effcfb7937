"""Splitting texts over a token limit at natural boundaries, by pointer doubling.

Every token position that begins a character is a boundary, of the strength of what ends before it: a paragraph, a line, a sentence, a word or
nothing. Each boundary is joined to its legal successor: the cut of the piece that begins there - the farthest one of
the strongest kind in the second half of the limit - less the overlap. The greedy cuts are the positions that the
beginning reaches over these pointers; they are found by squaring the pointer table, not by walking it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.tokens import STEP, clean, encoding, token_bytes
from heddle.session import spread

KINDS = ("character", "word", "sentence", "line", "paragraph")
#: Pieces this close to the limit are encoded again by themselves.
NEAR = 2
#: Sizes that one table of limits may hold; more are an error.
MOST_SIZES = 1000

_CLOSING, _STOP, _WIDE = (np.isin(np.arange(256), x) for x in ([34, 39, 41, 93], [33, 46, 63], [0xA6, 0x9D, 0x99]))
_PIECES = "doc_id bigint, size_tokens bigint, overlap_tokens bigint, piece_no int, first_token bigint, n_tokens bigint, boundary string, piece string"


def strengths(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How strong a cut before each byte of ``at`` is: 0 within a word to 4 after a paragraph; -1 within a character.

    ``data`` are the bytes of the text, ``at`` ascending positions in it. The text's end counts as a paragraph's.
    """
    n = len(data)
    blank = (data == 32) | (data == 9) | (data == 13)
    newline = data == 10
    # of each position: the last byte before it that is no blank, and whether that one ends a line or sentence
    index = np.arange(n)
    last = np.maximum.accumulate(np.where(~blank, index, -1)) if n else index
    solid = np.maximum.accumulate(np.where(~blank & ~newline, index, -1)) if n else index
    lines = np.append(0, np.cumsum(newline))
    out = np.zeros(len(at), np.int8)
    out[(at == 0) | (at == n)] = 4
    inner = np.flatnonzero((at > 0) & (at < n))
    p = at[inner]
    before = p - 1
    ended = newline[np.maximum(last[before], 0)] & (last[before] >= 0)
    since = lines[p] - lines[np.maximum(solid[before], 0)]  # line ends since the last letter before
    end = solid[before]
    mark = np.maximum(end, 0)
    mark = np.where(_CLOSING[data[mark]] & (end > 0), mark - 1, mark)
    gap = blank[before] | newline[before]
    next_gap = blank[p] | newline[p]
    word = gap | next_gap
    kind = np.where(word, 1, 0)
    # the typographic ellipsis and closing quotes end in one of these bytes after 0xE2 0x80
    wide = (end >= 2) & (data[np.maximum(end - 2, 0)] == 0xE2) & (data[np.maximum(end - 1, 0)] == 0x80) & _WIDE[data[np.maximum(end, 0)]]
    kind = np.where(word & (end >= 0) & (_STOP[data[mark]] | wide), 2, kind)
    kind = np.where(ended, np.where(since >= 2, 4, 3), kind)
    kind = np.where((data[p] & 0xC0) == 0x80, -1, kind)
    out[inner] = kind
    return out


def cuts(kind: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy pieces (begin, end) over boundaries 0..n of the given strengths; pieces have at most ``size`` tokens."""
    n = len(kind) - 1
    if n <= size:
        return [(0, n)]
    begin = np.arange(n + 1)
    reach = np.minimum(begin + size, n)
    least = np.minimum(begin + np.maximum(size // 2, overlap + 1), n)
    end = np.full(n + 1, -1)
    for k in range(4, -1, -1):
        latest = np.maximum.accumulate(np.where(kind >= k, begin, -1))[reach]
        end = np.where((end < 0) & (latest >= least), latest, end)
    # no character begins in the second half: the last one that begins later than the overlap, or a cut within
    latest = np.maximum.accumulate(np.where(kind >= 0, begin, -1))[reach]
    end = np.where(end < 0, np.where(latest > begin + overlap, latest, reach), end)
    end = np.where(begin + size >= n, n, end)
    legal = np.maximum.accumulate(np.where(kind >= 0, begin, 0))  # a piece begins with a whole character
    follow = np.where(end >= n, n, legal[end - np.where(end >= n, 0, overlap)])
    follow = np.where((follow <= begin) & (begin < n), np.minimum(end, n), follow)
    jump, starts = follow, np.array([0])
    while True:  # after k rounds ``starts`` holds the first 2**k pieces' beginnings
        more = jump[starts]
        if (more == n).all():
            break
        starts = np.unique(np.concatenate([starts, more[more < n]]))
        jump = jump[jump]
    starts = np.unique(np.concatenate([starts, more[more < n]]))
    return [(int(b), int(end[b])) for b in starts]


class Boundaries:
    """A text's bytes, tokens and the strength of each boundary between them."""

    def __init__(self, text: str, path: str | None = None, tokens: list[int] | None = None):
        self.enc = encoding(path)
        text = clean(text)
        tokens = self.enc.encode_ordinary(text) if tokens is None else tokens
        self.raw = text.encode()
        self.at = np.append(0, np.cumsum(token_bytes(path)[np.array(tokens, np.int64)]))
        self.kind = strengths(np.frombuffer(self.raw, np.uint8), self.at)

    def pieces(self, size: int, overlap: int) -> list[tuple[int, int, str, str]]:
        """Pieces (first token, tokens, boundary, text) if the text is over ``size`` tokens, else none.

        No piece has more tokens than ``size`` when it is encoded by itself; where the encoding around a cut differs
        from that of the whole text, the text is cut again a little shorter.
        """
        if len(self.kind) - 1 <= size:
            return []
        at = self.at.tolist()
        for less in (0, 4, 16, 64, size // 4, size // 2, size - overlap - 2):
            if less and size - less <= overlap + 1:
                continue
            cut = [(b, e, self.raw[at[b] : at[e]].decode("utf-8", "replace")) for b, e in cuts(self.kind, size - less, overlap)]
            near = 0 if less else size - NEAR  # if a shorter size was needed, all pieces are encoded again
            if all(len(self.enc.encode_ordinary(x)) <= size for b, e, x in cut if e - b >= near):
                break
        else:
            raise ValueError(f"no cut of a text keeps its pieces within {size} tokens")
        return [(b, e - b, KINDS[max(0, self.kind[e])], x) for b, e, x in cut]


def _splitter(limits: list[tuple[int, int]], path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP // 5):
                ids = batch.column(0).slice(at, STEP // 5).to_pylist()
                texts = [clean(x) for x in batch.column(1).slice(at, STEP // 5).to_pylist()]
                rows: list[tuple] = []
                for doc_id, text, tokens in zip(ids, texts, enc.encode_ordinary_batch(texts, num_threads=1)):
                    over = [x for x in limits if len(tokens) > x[0]]
                    text_cuts = Boundaries(text, path, tokens) if over else None
                    for size, overlap in over:
                        rows += [(doc_id, size, overlap, k, *piece) for k, piece in enumerate(text_cuts.pieces(size, overlap))]
                columns = list(zip(*rows)) if rows else [()] * 8
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "size_tokens", "overlap_tokens", "piece_no", "first_token", "n_tokens", "boundary", "piece"])

    return run


def split_documents(docs: DataFrame, limits: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, size_tokens, overlap_tokens, piece_no, first_token, n_tokens, boundary, piece) for each document over a 'split' size.

    ``docs`` has doc_id and text, ``limits`` purpose, size_tokens and overlap_tokens (null: 0; at most half the size
    less one is used). Consecutive pieces share overlap_tokens tokens of the whole text, or the few more that a piece
    needs to begin with a whole character. Texts within a size, null and blank ones have no pieces of it. A document
    given twice is split twice.
    """
    rows = limits.where("lower(trim(purpose)) = 'split' AND size_tokens > 1").select("size_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("o")).distinct().limit(MOST_SIZES + 1).collect()
    if len(rows) > MOST_SIZES:  # a table by hand: its size is checked
        raise ValueError(f"limits is meant to hold at most {MOST_SIZES} sizes")
    pairs = sorted({(int(r[0]), max(0, min(int(r[1]), int(r[0]) // 2 - 1))) for r in rows})
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(texts).mapInArrow(_splitter(pairs, path), _PIECES)
