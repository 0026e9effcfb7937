"""Command line: build an index, show its statistics, search interactively or in a batch."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from heddle.operators.index import Index, build_index
from heddle.plans import search as searching
from heddle.sources import documents

SHOWN = 5


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="heddle", description="Boolean search over a text corpus.")
    p.add_argument("-i", "--interactive", action="store_true", help="ask for queries until quit or exit")
    p.add_argument("-b", "--build", action="store_true", help="build the index from the data file")
    p.add_argument("-s", "--stats", action="store_true", help="show index statistics")
    p.add_argument("-f", "--file", help="file of queries, one per line")
    p.add_argument("-o", "--output", help="write results here")
    p.add_argument("-l", "--limit", type=int, default=searching.PAGE, help="results per query")
    p.add_argument("--index", default="heddle_index", help="folder of the index")
    p.add_argument("--data", default="documents.json", help="corpus: JSON lines, or a parquet folder")
    p.add_argument("query", nargs="*", help="a query")
    return p


def _build(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        docs = spark.read.parquet(args.data) if args.data.endswith(".parquet") else documents.read_json(spark, args.data)
    except (FileNotFoundError, ValueError) as e:
        print(f"Error: no documents loaded: {e}", file=sys.stderr)
        return 1
    build_index(docs).save(args.index)
    return _stats(spark, args)


def _stats(spark: SparkSession, args: argparse.Namespace) -> int:
    for name, value in Index.load(spark, args.index).statistics().first().asDict().items():
        print(f"{name}: {value:.2f}" if isinstance(value, float) else f"{name}: {value}")
    return 0


def _show(index: Index, query: str, limit: int) -> int:
    found = searching.search(index, query).cache()
    n = found.count()
    print(f"Found {n} documents")
    rows = searching.format_results(found, index, 0, limit).orderBy("rank").collect()
    for r in rows:
        print(f"{r['rank']}. {r.title}\n   {r.url}\n   {r.relevance:.4f}")
    if n > len(rows):
        print(f"... and {n - len(rows)} more")
    found.unpersist()
    return n


def _interactive(spark: SparkSession, args: argparse.Namespace, ask: Callable[[str], str]) -> int:
    index = Index.load(spark, args.index)
    while True:
        try:
            query = ask("> ").strip()
        except EOFError:
            return 0
        if query in ("quit", "exit"):
            return 0
        if query == "help":
            print("Terms side by side or with && must all occur, || takes either, ! excludes, ( ) group. quit ends.")
        elif query:
            n = _show(index, query, args.limit)
            if args.output:
                documents.append_log(args.output, query, n, int(time.time()))


def _batch(spark: SparkSession, args: argparse.Namespace) -> int:
    index = Index.load(spark, args.index)
    queries = documents.read_queries(args.file if args.file else " ".join(args.query))
    found = searching.batch_search(index, queries).cache()
    counts = {r.query_no: r.n for r in found.groupBy("query_no").agg(F.count("*").alias("n")).collect()}
    for k, query in enumerate(queries):
        n = counts.get(k, 0)
        print(f'\nQuery {k + 1}: "{query}"\n  Results: {n}')
        if n and args.limit > 0:
            rows = searching.format_results(found.where(F.col("query_no") == k), index, 0, min(args.limit, SHOWN)).orderBy("rank").collect()
            for r in rows:
                print(f"    {r['rank']}. {r.title}")
            if n > len(rows):
                print(f"    ... and {n - len(rows)} more")
    if args.output:
        title = F.when(F.col("title") == "", "Untitled Document").otherwise(F.col("title"))
        asked = spark.createDataFrame(list(enumerate(queries)), "query_no int, query string")
        hits = found.select("query_no", "doc_id").join(index.forward.select("doc_id", title.alias("title"), "url"), "doc_id")
        documents.write_batch_text(asked.join(hits, "query_no", "left"), args.output)
    found.unpersist()
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None, ask: Callable[[str], str] = input) -> int:
    """Builds, else shows statistics, else searches interactively, else runs the queries; 0 if that went well."""
    args = arguments().parse_args(argv)
    if not (args.build or args.stats or args.interactive or args.file or args.query):
        arguments().print_help()
        return 1
    spark = spark or SparkSession.builder.appName("heddle").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.build:
        return _build(spark, args)
    if args.stats:
        return _stats(spark, args)
    if args.interactive:
        return _interactive(spark, args, ask)
    return _batch(spark, args)


if __name__ == "__main__":
    sys.exit(main())
