"""Registered queries of sources and sinks: each writes a file of the whole tables, reads it back and returns its rows.

Files that the driver writes itself (index file, statistics) lie in the shared folder as well, which for them must be a
folder that all machines have mounted.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import corpus, zipf
from heddle.operators.index import document_rows
from heddle.plans import catalog
from heddle.plans import search as searching
from heddle.session import read_table, stage_path
from heddle.sources import documents, indexfile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _mounted(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _json_corpus(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "corpus-json")
    document_rows(read_table(spark, sf, "documents").drop("doc_id")).drop("key").write.json(path)
    return documents.read_json(spark, path).select("id", "url", "title", F.md5("content").alias("content_md5"), "source", "word_count")


_add("json_corpus", _json_corpus, "SELECT coalesce(id, '') AS id, coalesce(url, '') AS url, coalesce(title, '') AS title, md5(coalesce(text, '')) AS content_md5, coalesce(source, '') AS source, CAST(coalesce(word_count, 0) AS INTEGER) AS word_count FROM documents")


def _index_file(spark: SparkSession, sf: str):
    path = _mounted(stage_path(spark, "index-file"))
    indexfile.write(catalog._index(spark, sf), path)
    return indexfile.read(spark, path)


_add("index_file_forward", lambda s, p: _index_file(s, p).forward.select("doc_id", "url", "title", "doc_length", "checksum"), f"WITH {catalog._FWD} SELECT doc_id, url, title, doc_length, doc_id AS checksum FROM f")
_add("index_file_postings", lambda s, p: _index_file(s, p).postings.select("term", "doc_id"), f"WITH {catalog._POST} SELECT term, doc_id FROM p")
_add("index_file_term", lambda s, p: _index_file(s, p).find_term("coat"), f"WITH {catalog._POST} SELECT doc_id FROM p WHERE term = 'coat'")


def _zipf_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "zipf-csv")
    zipf.save_csv(zipf.zipf_table(catalog._ranks(spark, sf)), path)
    return spark.read.option("header", True).schema("rank bigint, frequency bigint, log_rank double, log_freq double, zipf_prediction double").csv(path)


def _digits(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0 ELSE round({x}, CAST(5 - floor(log10(abs({x}))) AS INTEGER)) END"


_add(
    "zipf_csv",
    _zipf_csv,
    f"""WITH {catalog._RANK}, {catalog._C}, z AS (SELECT rank, frequency, log10(rank) AS a, log10(frequency) AS b, log10(c / rank) AS z FROM rk, c)
    SELECT rank, frequency, {_digits("a")} AS log_rank, {_digits("b")} AS log_freq, {_digits("z")} AS zipf_prediction FROM z""",
)


def _token_stats_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "token-stats-csv")
    documents.write_token_stats_csv(corpus.token_stats(catalog._rows(spark, sf)), path)
    rows = spark.read.option("header", True).schema("doc_id bigint, doc_size_chars bigint, doc_size_kb double, num_tokens bigint, avg_token_length double, time_ms bigint").csv(path)
    return rows.select("doc_id", "doc_size_chars", F.round("doc_size_kb", 6).alias("doc_size_kb"), "num_tokens", F.round("avg_token_length", 6).alias("avg_token_length"))


_add("token_stats_csv", _token_stats_csv, f"SELECT doc_id, doc_size_chars, doc_size_kb, num_tokens, avg_token_length FROM ({catalog.SQL['token_stats_per_doc']})")


def _stemming_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "stemming-csv")
    documents.write_stemming_csv(catalog._stemming(spark, sf), path)
    return spark.read.option("header", True).schema("original string, stemmed string, original_count bigint, stemmed_count bigint").csv(path)


_add("stemming_csv", _stemming_csv, catalog.SQL["stemming_table"])


def _batch_text(spark: SparkSession, sf: str) -> DataFrame:
    """(line, n): the lines of the batch's result file, and how often each occurs."""
    index, path = catalog._index(spark, sf), stage_path(spark, "batch-text")
    found = searching.batch_search(index, catalog._BATCH).select("query_no", "doc_id")
    hits = found.join(index.forward.select("doc_id", "title", "url"), "doc_id")
    asked = spark.createDataFrame(list(enumerate(catalog._BATCH)), "query_no int, query string")
    documents.write_batch_text(asked.join(hits, "query_no", "left"), path)
    return spark.read.text(path).where("value <> ''").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


_WANTED = " UNION ALL ".join(f"SELECT {k} AS k, '{q}' AS q, doc_id FROM f WHERE {w}" for k, (q, w) in enumerate(zip(catalog._BATCH, catalog._BATCH_SQL)))
_ASKED = " UNION ALL ".join(f"SELECT {k} AS k, '{q}' AS q" for k, q in enumerate(catalog._BATCH))
_add(
    "batch_text",
    _batch_text,
    f"""WITH {catalog._FWD}, w AS ({_WANTED}), a AS ({_ASKED}), lines AS (
        SELECT 'Query: ' || q AS line FROM a UNION ALL SELECT 'Results: ' || (SELECT count(*) FROM w WHERE w.k = a.k) FROM a UNION ALL SELECT '  - ' || title || ' (' || url || ')' FROM w JOIN f USING (doc_id))
    SELECT line, count(*) AS n FROM lines GROUP BY 1""",
)


def _statistics_json(spark: SparkSession, sf: str) -> DataFrame:
    path, docs = _mounted(stage_path(spark, "statistics")), read_table(spark, sf, "documents")
    os.makedirs(path)
    documents.write_statistics(corpus.corpus_totals(docs), corpus.source_statistics(docs), f"{path}/statistics.json", f"{path}/report.txt")
    stats = spark.read.option("multiLine", True).json(f"{path}/statistics.json")
    return stats.select("total_documents", "total_words", F.explode("sources").alias("s")).select("total_documents", "total_words", "s.source", "s.documents", F.col("s.total_words").alias("words"))


_add(
    "statistics_json",
    _statistics_json,
    """SELECT (SELECT count(*) FROM documents) AS total_documents, (SELECT CAST(sum(coalesce(word_count, 0)) AS BIGINT) FROM documents) AS total_words, source, count(*) AS documents, CAST(sum(coalesce(word_count, 0)) AS BIGINT) AS words
    FROM documents GROUP BY source""",
)
