"""Token counts with a public byte-level BPE vocabulary. The vocabulary's path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.session import spread

#: Texts encoded at once.
STEP = 500


def default_path() -> str:
    """The vocabulary installed with the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoding(path: str | None = None):
    """The encoding of a file of base64 tokens and ranks; read once in each worker."""
    import public_tokenizers
    import tiktoken

    with open(path or default_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def token_bytes(path: str | None = None) -> np.ndarray:
    """Bytes of each token."""
    enc = encoding(path)
    sizes = np.zeros(enc.n_vocab + 1, np.int64)
    for token in range(enc.n_vocab):
        try:
            sizes[token] = len(enc.decode_single_token_bytes(token))
        except KeyError:  # an id without token
            pass
    return sizes


def clean(text: str) -> str:
    """Lone surrogates have no bytes; they become replacement characters."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8", "replace")


def sized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of each document with an id; null texts have 0 tokens. ``docs`` has doc_id, source and
    text; a document given more than once has that many rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            sizes: list[int] = []
            for at in range(0, batch.num_rows, STEP):
                texts = [clean(x or "") for x in batch.column(2).slice(at, STEP).to_pylist()]
                sizes += map(len, enc.encode_ordinary_batch(texts, num_threads=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "n_tokens"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    return spread(rows).mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")
