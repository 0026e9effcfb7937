"""Document and query sources and result sinks."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "id string, url string, title string, content string, source string, word_count int"


def fetch_documents(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Documents of a parquet table with defaults for missing fields; with a limit the first ones in order of id."""
    from heddle.operators.index import document_rows

    rows = document_rows(spark.read.parquet(path))
    return rows.drop("key") if limit is None else rows.orderBy("key").limit(limit).drop("key")


def count_documents(docs: DataFrame) -> int:
    return docs.count()


def read_json(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """A corpus of JSON lines, or of one JSON array; missing fields get defaults. A missing file raises FileNotFoundError,
    a corpus without documents ValueError."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    docs = spark.read.schema(DOCUMENT).option("multiLine", array).json(path)
    docs = docs.fillna("", ["id", "url", "title", "content", "source"]).fillna(0, ["word_count"])
    if docs.isEmpty():
        raise ValueError(f"no documents in {path}")
    return docs


def read_queries(path_or_query: str) -> list[str]:
    """The non-blank lines of a query file, or the argument itself where it names no file."""
    if not os.path.isfile(path_or_query):
        return [path_or_query]
    with open(path_or_query, encoding="utf-8") as lines:
        return [x.rstrip("\r\n") for x in lines if x.strip()]


def write_batch_text(results: DataFrame, path: str) -> None:
    """All hits of a batch as text: per query a head, the number of results and one line for each title and url.

    ``results`` has query_no, query, doc_id, title and url; doc_id is null for a query without hits.
    """
    lines = results.groupBy("query_no", "query").agg(F.count("doc_id").alias("n"), F.array_sort(F.collect_list(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "title", "url")))).alias("hits"))
    body = F.transform("hits", lambda h: F.concat(F.lit("  - "), h["title"], F.lit(" ("), h["url"], F.lit(")\n")))
    text = F.concat(F.lit("Query: "), "query", F.lit("\nResults: "), F.col("n").cast("string"), F.lit("\n"), F.array_join(body, ""))
    lines.orderBy("query_no").select(text.alias("value")).write.mode("overwrite").text(path)


def append_log(path: str, query: str, count: int, when: int) -> None:
    """One entry of the interactive result log."""
    with open(path, "a", encoding="utf-8") as log:
        log.write(f"Query: {query}\nResults: {count}\nTimestamp: {when}\n\n")


def write_statistics(totals: DataFrame, sources: DataFrame, json_path: str, report_path: str) -> dict | None:
    """Corpus statistics as JSON and as a text report; None for an empty corpus. One row per source goes to the driver."""
    one = totals.first()
    if one is None:
        return None
    rows = [r.asDict() for r in sources.orderBy(F.col("documents").desc(), "source").collect()]
    stats = {**one.asDict(), "sources": rows}
    with open(json_path, "w", encoding="utf-8") as out:
        json.dump(stats, out, ensure_ascii=False, indent=2)
    with open(report_path, "w", encoding="utf-8") as out:
        out.write(f"Documents: {stats['total_documents']:,}\nWords: {stats['total_words']:,}\nWords per document: {stats['avg_words_per_doc']:,.0f}\n")
        out.writelines(f"{r['source']}: {r['documents']:,} documents, {r['avg_words']:.0f} words on average\n" for r in rows)
    return stats


def write_token_stats_csv(stats: DataFrame, path: str) -> None:
    """``corpus.token_stats`` as CSV with a header. Documents are not timed one by one, so time_ms is empty unless given."""
    time = F.col("time_ms") if "time_ms" in stats.columns else F.lit(None).cast("bigint").alias("time_ms")
    stats.select("doc_id", "doc_size_chars", "doc_size_kb", "num_tokens", "avg_token_length", time).write.mode("overwrite").option("header", True).csv(path)


def write_stemming_csv(table: DataFrame, path: str) -> None:
    """``corpus.stemming_table`` as CSV with a header."""
    table.select("original", "stemmed", "original_count", "stemmed_count").write.mode("overwrite").option("header", True).csv(path)
