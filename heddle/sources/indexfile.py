"""The single-file binary index: a codec, and a Spark data source that reads its two sections.

Layout, little-endian: a header of 40 bytes - magic, version, flags, documents, terms, offset of the forward section,
offset of the inverted section, two reserved numbers -; the forward section - count, then for each document id (one
length byte), url and title (two length bytes), document length and checksum -; the inverted section - count, then for
each term in byte order the term (one length byte), its number of documents and their ids.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from heddle.operators.index import Index, inverted

MAGIC, VERSION = 0x48534146, 1
_HEADER = struct.Struct("<IHHIIQQII")


class IndexFileError(ValueError):
    """A file that is no index, of another version, or text too long for its length field."""


def _string(text: str, wide: bool) -> bytes:
    raw = text.encode()
    if len(raw) > (0xFFFF if wide else 0xFF):
        raise IndexFileError(f"String too long for {2 if wide else 1}-byte length")
    return struct.pack("<H" if wide else "<B", len(raw)) + raw


def write(index: Index, path: str) -> None:
    """Writes an index to one file. Rows stream through the driver in order; this is the exchange format, not the store."""
    forward = index.forward.select("doc_id", "id", "url", "title", "doc_length").orderBy("doc_id")
    terms = inverted(index.postings).select("term", "doc_ids").orderBy("term")
    with open(path, "wb") as out:
        out.write(bytes(_HEADER.size))
        starts, counts = [], []
        for rows, pack in ((forward, _forward_row), (terms, _term_row)):
            starts.append(out.tell())
            out.write(bytes(4))
            n = 0
            for row in rows.toLocalIterator():
                out.write(pack(row))
                n += 1
            counts.append(n)
            out.seek(starts[-1])
            out.write(struct.pack("<I", n))
            out.seek(0, 2)
        out.seek(0)
        out.write(_HEADER.pack(MAGIC, VERSION, 0, *counts, *starts, 0, 0))


def _forward_row(r) -> bytes:
    return _string(r.id, False) + _string(r.url, True) + _string(r.title, True) + struct.pack("<II", r.doc_length, r.doc_id)


def _term_row(r) -> bytes:
    return _string(r.term, False) + struct.pack(f"<I{len(r.doc_ids)}I", len(r.doc_ids), *r.doc_ids)


def read_header(file: BinaryIO) -> dict:
    raw = file.read(_HEADER.size)
    if len(raw) < _HEADER.size:
        raise IndexFileError("Invalid index file")
    magic, version, _, documents, terms, forward, inverted_at, _, _ = _HEADER.unpack(raw)
    if magic != MAGIC:
        raise IndexFileError("Invalid index file")
    if version != VERSION:
        raise IndexFileError(f"Unsupported index version {version}")
    return {"documents": documents, "terms": terms, "forward": forward, "inverted": inverted_at}


def _text(file: BinaryIO, wide: bool) -> str:
    (n,) = struct.unpack("<H" if wide else "<B", file.read(2 if wide else 1))
    return file.read(n).decode()


def _number(file: BinaryIO) -> int:
    return struct.unpack("<I", file.read(4))[0]


def read_forward(file: BinaryIO) -> Iterator[tuple]:
    file.seek(read_header(file)["forward"])
    yield from _forward_rows(file, 0, _number(file))


def _forward_rows(file: BinaryIO, first: int, rows: int) -> Iterator[tuple]:
    for doc_id in range(first, first + rows):
        yield doc_id, _text(file, False), _text(file, True), _text(file, True), _number(file), _number(file)


def read_inverted(file: BinaryIO, only: str | None = None) -> Iterator[tuple]:
    """(term, df, doc_ids); with ``only`` the lists of other terms are skipped, and reading ends behind its place in order."""
    file.seek(read_header(file)["inverted"])
    yield from _inverted_rows(file, _number(file), only)


def _inverted_rows(file: BinaryIO, rows: int, only: str | None) -> Iterator[tuple]:
    for _ in range(rows):
        term, n = _text(file, False), _number(file)
        if only is not None and term.encode() > only.encode():
            return
        if only is not None and term != only:
            file.seek(4 * n, 1)
        else:
            yield term, n, list(struct.unpack(f"<{n}I", file.read(4 * n)))


class IndexFileSource(DataSource):
    """``spark.read.format("heddle_index").option("section", "forward" or "inverted").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "heddle_index"

    def schema(self) -> str:
        if self.options.get("section", "inverted") == "forward":
            return "doc_id bigint, id string, url string, title string, doc_length bigint, checksum bigint"
        return "term string, df bigint, doc_ids array<bigint>"

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return _TermReader(options) if options.get("pushdown") == "true" and options.get("section", "inverted") == "inverted" else _Reader(options)


@dataclass
class _Stretch(InputPartition):
    """Rows of a section from an offset on."""

    offset: int
    first: int
    rows: int


def stretches(path: str, section: str, rows: int) -> list[_Stretch]:
    """Where every so many rows of a section begin; found by the lengths in the file, without reading lists and texts."""
    out: list[_Stretch] = []
    with open(path, "rb") as file:
        at = read_header(file)[section]
        with mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as data:
            (n,) = struct.unpack_from("<I", data, at)
            at += 4
            for k in range(n):
                if k % rows == 0:
                    out.append(_Stretch(at, k, min(rows, n - k)))
                at += 1 + data[at]
                if section == "forward":
                    for _ in range(2):
                        at += 2 + struct.unpack_from("<H", data, at)[0]
                    at += 8
                else:
                    at += 4 + 4 * struct.unpack_from("<I", data, at)[0]
    return out


class _Reader(DataSourceReader):
    """The path must be one that all executors can open, like the format's other readers do."""

    def __init__(self, options: dict):
        self.path, self.section, self.only = options["path"], options.get("section", "inverted"), None
        self.rows = int(options.get("rowsperpartition", 1 << 16))

    def partitions(self) -> list[InputPartition]:
        return stretches(self.path, self.section, self.rows)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as file:
            file.seek(partition.offset)
            if self.section == "forward":
                yield from _forward_rows(file, partition.first, partition.rows)
            else:
                yield from _inverted_rows(file, partition.rows, self.only)


class _TermReader(_Reader):
    """Takes a condition term = ..., where the session allows filters to be pushed to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("term",):
                self.only = f.value
            yield f  # checked again, as more than one may come


def read(spark: SparkSession, path: str) -> Index:
    """The index of a file; the format does not keep term frequencies, they are 1."""
    spark.dataSource.register(IndexFileSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    source = lambda s: spark.read.format("heddle_index").option("section", s).option("pushdown", pushed).load(path)
    postings: DataFrame = source("inverted").select("term", F.explode("doc_ids").alias("doc_id"), F.lit(1).cast("bigint").alias("tf"))
    return Index(source("forward"), postings)
