"""Boolean search over an index: one posting scan and one aggregate for each query, or for a whole batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.operators.index import UNTITLED, Index
from heddle.plans.parser import Node, QueryError, evaluate, lex, parse, terms_of

#: Terms of one query that the batch plan numbers in a truth table.
TABLE_TERMS = 10
PAGE = 50


@dataclass(frozen=True)
class SearchStats:
    query: str
    result_count: int
    terms_processed: int


def _stemmed(index: Index, terms: list[str]) -> dict[str, str]:
    """What the terms become when a query is stemmed like the documents are."""
    from heddle.functions.stemmer import stem

    rows = index.postings.sparkSession.createDataFrame([(t,) for t in terms], "t string").select("t", stem(F.col("t"))).collect()
    return {r[0]: r[1] for r in rows}


def _tree(query: str, strict: bool) -> Node | None:
    try:
        return parse(query, strict)
    except QueryError:
        return None


def _column(node: Node, flags: dict[str, Column]) -> Column:
    return evaluate(node, flags.__getitem__, lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)


def search(index: Index, query: str, strict: bool = False, stem_query: bool = False) -> DataFrame:
    """(doc_id) of the documents that match; none for a query that can't be read.

    Only the postings of the query's terms are read. A query that holds for documents without any of its terms (one
    with a free negation) is completed from the forward table.
    """
    node = _tree(query, strict)
    if node is None:
        return index.forward.select("doc_id").where(F.lit(False))
    terms = terms_of(node)
    indexed = _stemmed(index, terms) if stem_query else {t: t for t in terms}
    flag = {t: f"f{k}" for k, t in enumerate(terms)}
    found = index.postings.where(F.col("term").isin(*indexed.values())).groupBy("doc_id").agg(*[F.bool_or(F.col("term") == indexed[t]).alias(flag[t]) for t in terms])
    if evaluate(node, lambda _: False):
        found = index.forward.select("doc_id").join(found, "doc_id", "left")
        return found.where(_column(node, {t: F.coalesce(F.col(flag[t]), F.lit(False)) for t in terms})).select("doc_id")
    return found.where(_column(node, {t: F.col(flag[t]) for t in terms})).select("doc_id")


def search_stats(index: Index, query: str, strict: bool = False, stem_query: bool = False) -> SearchStats:
    """Number of results and of lexemes, operators and end included."""
    return SearchStats(query, search(index, query, strict, stem_query).count(), len(lex(query, strict)))


def batch_search(index: Index, queries: list[str], strict: bool = False, stem_query: bool = False) -> DataFrame:
    """(query_no, query, doc_id) for all queries in one job; numbers follow the input, repeated queries have their own rows.

    Each query's terms are bits of a mask; one aggregate per (query, document) gathers them, and the masks for which a
    query holds stand in a table of at most 2**TABLE_TERMS rows per query. Queries of more terms run by themselves.
    """
    spark = index.postings.sparkSession
    bits, masks, free, single = [], [], [], []
    trees = {k: _tree(q, strict) for k, q in enumerate(queries)}
    stems = _stemmed(index, sorted({t for n in trees.values() if n is not None for t in terms_of(n)})) if stem_query else {}
    for k, node in trees.items():
        if node is None:
            continue
        terms = terms_of(node)
        if len(terms) > TABLE_TERMS:
            single.append(k)
            continue
        bits += [(k, stems.get(t, t), bit) for bit, t in enumerate(terms)]
        masks += [(k, m) for m in range(1, 1 << len(terms)) if evaluate(node, lambda t, m=m: bool(m >> terms.index(t) & 1))]
        if evaluate(node, lambda _: False):
            free.append(k)
    # the tables' sizes are those of the queries' text
    of = spark.createDataFrame(bits, "query_no int, term string, bit int")
    good = spark.createDataFrame(masks, "query_no int, mask bigint")
    touched = index.postings.join(F.broadcast(of), "term").groupBy("query_no", "doc_id").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    out = touched.join(F.broadcast(good), ["query_no", "mask"]).select("query_no", "doc_id")
    if free:
        all_free = index.forward.select("doc_id", F.explode(F.array(*map(F.lit, free))).alias("query_no"))
        rest = all_free.join(touched.where(F.col("query_no").isin(*free)), ["query_no", "doc_id"], "left_anti")
        out = out.unionByName(rest.select("query_no", "doc_id"))
    for k in single:
        out = out.unionByName(search(index, queries[k], strict, stem_query).select(F.lit(k).alias("query_no"), "doc_id"))
    texts = spark.createDataFrame(list(enumerate(queries)), "query_no int, query string")
    return out.join(F.broadcast(texts), "query_no").select("query_no", "query", "doc_id")


def format_results(results: DataFrame, index: Index, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """(rank, doc_id, title, url, relevance) of one page in order of doc_id; relevance is 1 over the position in the
    whole result, counted from 1. Ids that the index doesn't know are left out, but keep their position."""
    page = results.select("doc_id").orderBy("doc_id").limit(offset + limit)
    numbered = page.withColumn("rank", F.row_number().over(Window.orderBy("doc_id"))).where(F.col("rank") > offset)
    title = F.when(F.col("title") == "", UNTITLED).otherwise(F.col("title"))
    rows = index.forward.select("doc_id", "url", title.alias("title")).join(F.broadcast(numbered), "doc_id")  # at most offset + limit rows
    return rows.select(F.col("rank").cast("bigint").alias("rank"), "doc_id", "title", "url", (F.lit(1.0) / F.col("rank")).alias("relevance"))
