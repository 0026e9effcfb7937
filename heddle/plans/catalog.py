"""Registered queries of the engine's own operators, and the same in SQL.

Each runs over its whole tables. The SQL shares three fragments: documents with ordinals, tokens, and stems.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import stemmer, text, tokenizer, url
from heddle.operators import corpus, crawl, ledger, zipf
from heddle.operators.index import Index, build_index, document_rows, document_tokens, inverted, inverted_blocks, vocabulary
from heddle.operators.numbering import with_ordinal
from heddle.plans import search as searching
from heddle.session import once, read_table, stage_path, write_stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "url", "title", F.col("text").alias("content"), "source", "word_count")


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by their own id, with defaults for what is missing."""
    return document_rows(_docs(spark, sf)).withColumnRenamed("key", "doc_id")


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return document_tokens(_rows(spark, sf))


def _frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return zipf.term_frequency(_counts(spark, sf))


def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    return zipf.ranked(_frequencies(spark, sf))


def _index(spark: SparkSession, sf: str) -> Index:
    """Built and saved once per session and folder, as a search engine's index is; sorted by term, so that lookups prune."""

    def build() -> str:
        path = stage_path(spark, "index")
        build_index(_docs(spark, sf)).save(path)
        return path

    return Index.load(spark, once(spark, ("index", sf), build, "postings/_SUCCESS"))


# SQL fragments
_D = "d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id, coalesce(url, '') AS url, coalesce(title, '') AS title, coalesce(text, '') AS content, coalesce(source, '') AS source, source AS raw_source, coalesce(word_count, 0) AS word_count, text FROM documents)"
_T = f"{_D}, t AS MATERIALIZED (SELECT ord, doc_id, token, count(*) AS tf FROM (SELECT ord, doc_id, unnest({tokenizer.tokens_sql('content')}) AS token FROM d) GROUP BY ALL)"
_FREQ = f"{_T}, fr AS (SELECT token, CAST(sum(tf) AS BIGINT) AS frequency FROM t GROUP BY 1)"
_RANK = f"{_FREQ}, rk AS (SELECT row_number() OVER (ORDER BY frequency DESC, token) AS rank, token, frequency FROM fr)"
_VOC = f"{_T}, voc AS (SELECT DISTINCT token FROM t), {stemmer.stem_ctes('voc')}"
_POST = f"{_VOC}, p AS MATERIALIZED (SELECT stem AS term, ord AS doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM t JOIN stems USING (token) WHERE length(stem) BETWEEN 2 AND 50 GROUP BY ALL)"
_FWD = f"{_POST}, f AS (SELECT d.ord AS doc_id, d.url, d.title, count(p.term) AS doc_length FROM d LEFT JOIN p ON p.doc_id = d.ord GROUP BY ALL)"


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


# ---- documents and text
_add("fetch_documents", lambda s, p: _rows(s, p).select("doc_id", "url", "title", "source", "word_count", F.md5("content").alias("content_md5")), f"WITH {_D} SELECT doc_id, url, title, source, CAST(word_count AS INTEGER) AS word_count, md5(content) AS content_md5 FROM d")
_add("count_documents", lambda s, p: read_table(s, p, "documents").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM documents")
_add("tokenize_counts", lambda s, p: _counts(s, p).select("doc_id", "token", "tf"), f"WITH {_T} SELECT doc_id, token, tf FROM t")
_add("tokenize_titles", lambda s, p: _rows(s, p).select("doc_id", F.array_join(tokenizer.tokens(F.col("title")), " ").alias("tokens")), f"WITH {_D} SELECT doc_id, coalesce(array_to_string({tokenizer.tokens_sql('title')}, ' '), '') AS tokens FROM d")
_STATS = f"st AS (SELECT doc_id, CAST(octet_length(encode(content)) AS BIGINT) AS doc_size_chars, {tokenizer.tokens_sql('content')} AS tk FROM d)"
_add(
    "token_stats_per_doc",
    lambda s, p: corpus.token_stats(_rows(s, p)).select("doc_id", "doc_size_chars", F.round("doc_size_kb", 6).alias("doc_size_kb"), "num_tokens", "token_chars", F.round("avg_token_length", 6).alias("avg_token_length")),
    f"""WITH {_D}, {_STATS}, c AS (SELECT doc_id, doc_size_chars, CAST(len(tk) AS BIGINT) AS num_tokens, CAST(coalesce(list_sum(list_transform(tk, lambda x: length(x))), 0) AS BIGINT) AS token_chars FROM st)
    SELECT doc_id, doc_size_chars, round(doc_size_chars / 1024.0, 6) AS doc_size_kb, num_tokens, token_chars, round(CASE WHEN num_tokens > 0 THEN token_chars / num_tokens ELSE 0 END, 6) AS avg_token_length FROM c""",
)
_MATCH = f"regexp_extract_all(content, '{tokenizer.MATCH_RE2.replace(chr(39), chr(39) * 2)}', 0)"
_add(
    "hashtags",
    lambda s, p: _rows(s, p).select("doc_id", F.explode(tokenizer.hashtags(F.col("content"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("uses"), F.count_distinct("doc_id").alias("documents")),
    f"""WITH {_D}, m AS (SELECT doc_id, lower(regexp_extract(x, '^#([A-Za-z0-9_]*)', 1)) AS tag FROM (SELECT doc_id, unnest({_MATCH}) AS x FROM d) WHERE starts_with(x, '#'))
    SELECT tag, count(*) AS uses, count(DISTINCT doc_id) AS documents FROM m WHERE length(tag) > 1 GROUP BY 1""",
)
_add(
    "mention_skip",
    lambda s, p: _rows(s, p).select("doc_id", F.size(F.filter(tokenizer.matches(F.col("content")), lambda m: m.startswith("@"))).cast("bigint").alias("mentions")),
    f"WITH {_D} SELECT doc_id, CAST(len(list_filter({_MATCH}, lambda x: starts_with(x, '@'))) AS BIGINT) AS mentions FROM d",
)
_STOPS = ", ".join(f"'{w}'" for w in tokenizer.STOP_WORDS)
_add(
    "stopword_filter",
    lambda s, p: _rows(s, p).select(F.explode(tokenizer.matches(F.col("content"))).alias("m")).where("NOT startswith(m, '#') AND NOT startswith(m, '@')").select(F.lower("m").alias("word")).where(tokenizer.is_filtered(F.col("word"))).groupBy("word").agg(F.count("*").alias("n")),
    f"""WITH {_D}, m AS (SELECT lower(x) AS word FROM (SELECT unnest({_MATCH}) AS x FROM d) WHERE NOT starts_with(x, '#') AND NOT starts_with(x, '@'))
    SELECT word, count(*) AS n FROM m WHERE word IN ({_STOPS}) OR starts_with(word, 'http') OR regexp_matches(word, '^[0-9]+$') GROUP BY 1""",
)
_add("stem_vocabulary", lambda s, p: vocabulary(_counts(s, p)), f"WITH {_VOC} SELECT token, stem FROM stems")
_add("measure", lambda s, p: vocabulary(_counts(s, p)).select("token", stemmer.measure(F.col("token")).cast("bigint").alias("measure")), f"WITH {_VOC} SELECT token, CAST(len(regexp_extract_all(token, '[aeiou]+')) AS BIGINT) AS measure FROM voc")
_add(
    "normalize_index_terms",
    lambda s, p: write_stage(vocabulary(_counts(s, p)), "vocabulary").where(F.length("stem").between(2, 50)).groupBy("stem").agg(F.count("*").alias("tokens")).withColumnRenamed("stem", "term"),
    f"WITH {_VOC} SELECT stem AS term, count(*) AS tokens FROM stems WHERE length(stem) BETWEEN 2 AND 50 GROUP BY 1",
)
_add("word_count", lambda s, p: _rows(s, p).select("doc_id", text.word_count(F.col("content")).cast("bigint").alias("words")), f"WITH {_D} SELECT doc_id, CAST(len(regexp_extract_all(content, '[^ \\t\\n\\r\\f\\v]+')) AS BIGINT) AS words FROM d")
_add(
    "keyword_hits",
    lambda s, p: _rows(s, p).select("doc_id", text.keyword_hits(F.col("content")).cast("bigint").alias("hits")).withColumn("on_topic", F.col("hits") >= 3),
    f"WITH {_D}, k AS (SELECT doc_id, CAST({' + '.join(f'''CAST(contains(lower(content), '{k}') AS INTEGER)''' for k in text.TOPIC_KEYWORDS)} AS BIGINT) AS hits FROM d) SELECT doc_id, hits, hits >= 3 AS on_topic FROM k",
)

# ---- index
_add("postings", lambda s, p: _index(s, p).postings.select("term", "doc_id", "tf"), f"WITH {_POST} SELECT term, doc_id, tf FROM p")
_add("doc_frequency", lambda s, p: _index(s, p).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences")), f"WITH {_POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM p GROUP BY 1")
_add("forward_index", lambda s, p: _index(s, p).forward.select("doc_id", "url", "title", "doc_length", "checksum"), f"WITH {_FWD} SELECT doc_id, url, title, doc_length, doc_id AS checksum FROM f")
_add("doc_length", lambda s, p: _index(s, p).forward.groupBy("doc_length").agg(F.count("*").alias("documents")), f"WITH {_FWD} SELECT doc_length, count(*) AS documents FROM f GROUP BY 1")
_add(
    "index_statistics",
    lambda s, p: _index(s, p).statistics().select("total_documents", "total_terms", "total_postings", F.round("avg_term_length", 6).alias("avg_term_length"), F.round("avg_doc_length", 6).alias("avg_doc_length")),
    f"""WITH {_FWD} SELECT (SELECT count(*) FROM f) AS total_documents, (SELECT count(DISTINCT term) FROM p) AS total_terms, (SELECT count(*) FROM p) AS total_postings,
    (SELECT round(avg(length(term)), 6) FROM (SELECT DISTINCT term FROM p)) AS avg_term_length, (SELECT round(avg(doc_length), 6) FROM f) AS avg_doc_length""",
)
_add("find_term", lambda s, p: _index(s, p).find_term("coat"), f"WITH {_POST} SELECT doc_id FROM p WHERE term = 'coat'")
_add("document_info", lambda s, p: _index(s, p).document_info(42).select("doc_id", "url", "title", "doc_length"), f"WITH {_FWD} SELECT doc_id, url, title, doc_length FROM f WHERE doc_id = 42")
_add(
    "sorted_dictionary",
    lambda s, p: with_ordinal(_index(s, p).postings.select("term").distinct(), [F.col("term")], "position").select("position", "term"),
    f"WITH {_POST} SELECT row_number() OVER (ORDER BY term) - 1 AS position, term FROM (SELECT DISTINCT term FROM p)",
)
_add(
    "postings_array",
    lambda s, p: inverted(_index(s, p).postings).select("term", "df", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids")),
    f"WITH {_POST} SELECT term, count(*) AS df, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids FROM p GROUP BY 1",
)

_add(
    "postings_blocks",
    lambda s, p: inverted_blocks(_index(s, p).postings, 100).select("term", "block", "df", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids")),
    f"WITH {_POST} SELECT term, CAST(doc_id // 100 AS BIGINT) AS block, count(*) AS df, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids FROM p GROUP BY 1, 2",
)


# ---- search: each query's condition in SQL is over the sets of documents
def _in(term: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM p WHERE term = '{term}')"


_SEARCHES = {
    "search_term": ("coat", _in("coat")),
    "search_and": ("coat && silk", f"{_in('coat')} AND {_in('silk')}"),
    "search_implicit_and": ("coat silk", f"{_in('coat')} AND {_in('silk')}"),
    "search_or": ("silk || velvet", f"{_in('silk')} OR {_in('velvet')}"),
    "search_not": ("!coat && silk", f"NOT {_in('coat')} AND {_in('silk')}"),
    "search_double_not": ("!!coat", _in("coat")),
    "search_complement": ("!coat", f"NOT {_in('coat')}"),
    "search_nested_parens": ("of && (la || der || coat)", f"{_in('of')} AND ({_in('la')} OR {_in('der')} OR {_in('coat')})"),
    "search_precedence": ("!coat && silk || der", f"(NOT {_in('coat')} AND {_in('silk')}) OR {_in('der')}"),
    "search_not_unknown_is_all": ("!xyzzyunknown", "TRUE"),
    "search_unknown_and_is_empty": ("xyzzyunknown && coat", "FALSE"),
    "search_not_after_term_ignored": ("coat !silk", _in("coat")),
    "search_hyphen_negates": ("coat-silk", _in("coat")),
    "search_unreadable": ("(coat", "FALSE"),
    "search_unstemmed_query": ("textile", _in("textile")),
}
for _name, (_query, _where) in _SEARCHES.items():
    _add(_name, lambda s, p, q=_query: searching.search(_index(s, p), q), f"WITH {_FWD} SELECT doc_id FROM f WHERE {_where}")
_add("search_stemmed_query_option", lambda s, p: searching.search(_index(s, p), "textiles && shirts", stem_query=True), f"WITH {_FWD} SELECT doc_id FROM f WHERE {_in('textil')} AND {_in('shirt')}")
_add("search_strict_mode", lambda s, p: searching.search(_index(s, p), "coat AND NOT silk", strict=True), f"WITH {_FWD} SELECT doc_id FROM f WHERE {_in('coat')} AND NOT {_in('silk')}")


def _search_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = searching.search_stats(_index(spark, sf), "of && (la || der)")
    return spark.createDataFrame([(stats.query, stats.result_count, stats.terms_processed)], "query string, result_count bigint, terms_processed bigint")


_add("search_stats", _search_stats, f"WITH {_FWD} SELECT 'of && (la || der)' AS query, count(*) AS result_count, CAST(8 AS BIGINT) AS terms_processed FROM f WHERE {_in('of')} AND ({_in('la')} OR {_in('der')})")
_BATCH = ["coat", "silk || velvet", "!coat && silk", "of && (la || der || coat)", "!xyzzyunknown", "coat", "a &&"]
_BATCH_SQL = [_in("coat"), f"{_in('silk')} OR {_in('velvet')}", f"NOT {_in('coat')} AND {_in('silk')}", f"{_in('of')} AND ({_in('la')} OR {_in('der')} OR {_in('coat')})", "TRUE", _in("coat"), "FALSE"]
_add(
    "search_batch",
    lambda s, p: searching.batch_search(_index(s, p), _BATCH),
    f"WITH {_FWD} " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS query_no, '{q}' AS query, doc_id FROM f WHERE {w}" for k, (q, w) in enumerate(zip(_BATCH, _BATCH_SQL))),
)
_UNIVERSE = f"WITH {_FWD} SELECT doc_id FROM f"
_add("search_universe", lambda s, p: _index(s, p).forward.select("doc_id"), _UNIVERSE)


def _page(offset: int, limit: int) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        index = _index(spark, sf)
        page = searching.format_results(searching.search(index, "coat"), index, offset, limit)
        return page.withColumn("relevance", F.round("relevance", 6))

    sql = f"""WITH {_FWD}, r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM f WHERE {_in("coat")})
    SELECT rank, doc_id, CASE WHEN title = '' THEN 'Untitled Document' ELSE title END AS title, url, round(1.0 / rank, 6) AS relevance FROM r JOIN f USING (doc_id) WHERE rank > {offset} AND rank <= {offset + limit}"""
    return query, sql


_add("format_page1", *_page(0, 50))
_add("format_page2", *_page(50, 50))

# ---- frequencies and fits
_add("term_frequency", _frequencies, f"WITH {_FREQ} SELECT token, frequency FROM fr")
_add("rank_frequency", lambda s, p: _ranks(s, p).select("rank", "token", "frequency"), f"WITH {_RANK} SELECT rank, token, frequency FROM rk")
_C = "c AS (SELECT sum(frequency) / sum(1.0 / rank) AS c FROM rk WHERE rank <= 1000)"
_add("zipf_constant", lambda s, p: zipf.zipf_constant(_ranks(s, p)).select(F.round("zipf_constant", 4).alias("zipf_constant")), f"WITH {_RANK}, {_C} SELECT round(c, 4) AS zipf_constant FROM c")
_add(
    "zipf_table",
    lambda s, p: zipf.zipf_table(_ranks(s, p)).select("rank", "frequency", *[F.round(c, 6).alias(c) for c in ("log_rank", "log_freq", "zipf_prediction")]),
    f"WITH {_RANK}, {_C} SELECT rank, frequency, round(log10(rank), 6) AS log_rank, round(log10(frequency), 6) AS log_freq, round(log10(c / rank), 6) AS zipf_prediction FROM rk, c",
)
_add("mandelbrot", lambda s, p: _ranks(s, p).select("rank", F.round(zipf.mandelbrot(F.col("rank"), 1350000, 2.5, 1.08), 4).alias("predicted")), f"WITH {_RANK} SELECT rank, round(1350000 / pow(rank + 2.5, 1.08), 4) AS predicted FROM rk")
_add("top20_share", lambda s, p: corpus.top_share(_frequencies(s, p)).withColumn("share", F.round("share", 6)), f"WITH {_RANK} SELECT rank, token, frequency, round(frequency * 100.0 / (SELECT sum(frequency) FROM fr), 6) AS share FROM rk WHERE rank <= 20")
_add("token_totals", lambda s, p: zipf.summary(_frequencies(s, p)), f"WITH {_FREQ} SELECT CAST(sum(frequency) AS BIGINT) AS total_tokens, count(*) AS unique_tokens FROM fr")
_add(
    "vocabulary_reduction",
    lambda s, p: corpus.vocabulary_reduction(vocabulary(_counts(s, p))).withColumn("reduction", F.round("reduction", 6)),
    f"WITH {_VOC}, n AS (SELECT count(DISTINCT token) AS before, count(DISTINCT stem) AS after FROM stems) SELECT before, after, round((1 - after / before) * 100, 6) AS reduction FROM n",
)


def _stemming(spark: SparkSession, sf: str) -> DataFrame:
    frequencies = write_stage(_frequencies(spark, sf), "frequencies")
    return corpus.stemming_table(frequencies, frequencies.select("token", stemmer.stem(F.col("token")).alias("stem")))


_add(
    "stemming_table",
    _stemming,
    f"""WITH {_VOC}, fr AS (SELECT token, CAST(sum(tf) AS BIGINT) AS frequency FROM t GROUP BY 1), b AS (SELECT * FROM fr JOIN stems USING (token))
    SELECT token AS original, stem AS stemmed, frequency AS original_count, CAST(sum(frequency) OVER (PARTITION BY stem) AS BIGINT) AS stemmed_count FROM b""",
)


def _token_summary(spark: SparkSession, sf: str) -> DataFrame:
    unique = _frequencies(spark, sf).agg(F.count("*")).scalar()
    out = corpus.token_summary(corpus.token_stats(_rows(spark, sf)), unique)
    return out.select("documents", "total_tokens", "unique_tokens", *[F.round(c, 4).alias(c) for c in ("avg_token_length", "token_kb", "tokens_per_kb")])


_add(
    "corpus_token_summary",
    _token_summary,
    f"""WITH {_FREQ}, s AS (SELECT sum(frequency) AS n, sum(frequency * length(token)) AS ch, count(*) AS u FROM fr)
    SELECT (SELECT count(*) FROM d) AS documents, CAST(n AS BIGINT) AS total_tokens, u AS unique_tokens, round(ch / n, 4) AS avg_token_length, round(ch / 1024, 4) AS token_kb, round(n / (ch / 1024), 4) AS tokens_per_kb FROM s""",
)
_add("occurrences_by_stem", lambda s, p: _index(s, p).postings.groupBy("term").agg(F.sum("tf").alias("occurrences")), f"WITH {_POST} SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences FROM p GROUP BY 1")

# ---- corpus
_add(
    "source_statistics",
    lambda s, p: corpus.source_statistics(read_table(s, p, "documents")).withColumn("avg_words", F.round("avg_words", 4)),
    """SELECT source, count(*) AS documents, CAST(sum(coalesce(word_count, 0)) AS BIGINT) AS total_words, round(avg(coalesce(word_count, 0)), 4) AS avg_words,
    CAST(min(coalesce(word_count, 0)) AS BIGINT) AS min_words, CAST(max(coalesce(word_count, 0)) AS BIGINT) AS max_words FROM documents GROUP BY 1""",
)
_add(
    "corpus_totals",
    lambda s, p: corpus.corpus_totals(read_table(s, p, "documents")).withColumn("avg_words_per_doc", F.round("avg_words_per_doc", 4)),
    "SELECT count(*) AS total_documents, CAST(sum(coalesce(word_count, 0)) AS BIGINT) AS total_words, round(sum(coalesce(word_count, 0)) / count(*), 4) AS avg_words_per_doc FROM documents",
)


def _case(value: str, edges: list[int]) -> str:
    low, parts = 0, []
    for e in edges:
        parts.append(f"WHEN {value} <= {e} THEN '{f'{low}-{e}' if low != e else e}'")
        low = e + 1
    return f"CASE {' '.join(parts)} ELSE '{low}+' END"


_WORDS, _LENGTHS, _LISTS = [500, 1000, 1500, 2000, 2500, 3000], [2, 4, 6, 8, 10, 15], [0, 1, 2, 10, 100, 1000]
_add("length_histogram", lambda s, p: _rows(s, p).groupBy(corpus.histogram(text.word_count(F.col("content")), _WORDS).alias("bucket")).agg(F.count("*").alias("documents")), f"WITH {_D}, w AS (SELECT len(regexp_extract_all(content, '[^ \\t\\n\\r\\f\\v]+')) AS n FROM d) SELECT {_case('n', _WORDS)} AS bucket, count(*) AS documents FROM w GROUP BY 1")
_add("token_length_histogram", lambda s, p: _frequencies(s, p).groupBy(corpus.histogram(F.length("token"), _LENGTHS).alias("bucket")).agg(F.sum("frequency").alias("tokens")), f"WITH {_FREQ} SELECT {_case('length(token)', _LENGTHS)} AS bucket, CAST(sum(frequency) AS BIGINT) AS tokens FROM fr GROUP BY 1")
_add("posting_length_histogram", lambda s, p: _index(s, p).postings.groupBy("term").count().groupBy(corpus.histogram(F.col("count"), _LISTS).alias("bucket")).agg(F.count("*").alias("terms")), f"WITH {_POST}, n AS (SELECT term, count(*) AS n FROM p GROUP BY 1) SELECT {_case('n', _LISTS)} AS bucket, count(*) AS terms FROM n GROUP BY 1")
_add(
    "lexical_diversity",
    lambda s, p: corpus.lexical_diversity(_frequencies(s, p)).select(*[F.round(c, 6).alias(c) for c in ("diversity", "mean_length", "stddev_length")]),
    f"""WITH {_FREQ}, m AS (SELECT sum(frequency) AS n, count(*) AS u, sum(length(token) * frequency) / sum(frequency) AS a, sum(length(token) * length(token) * frequency) / sum(frequency) AS q FROM fr)
    SELECT round(u / n, 6) AS diversity, round(a, 6) AS mean_length, round(sqrt(q - a * a), 6) AS stddev_length FROM m""",
)
_add(
    "entropy",
    lambda s, p: corpus.entropy(_frequencies(s, p)).select(F.round("entropy", 6).alias("entropy"), F.round("perplexity", 2).alias("perplexity")),
    f"WITH {_FREQ}, e AS (SELECT -sum((frequency / n) * log2(frequency / n)) AS h FROM fr, (SELECT sum(frequency) AS n FROM fr)) SELECT round(h, 6) AS entropy, round(pow(2, h), 2) AS perplexity FROM e",
)
_add(
    "loglog_fit",
    lambda s, p: corpus.loglog_fit(zipf.zipf_table(_ranks(s, p))).select(F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2")),
    f"WITH {_RANK} SELECT round(regr_slope(log10(frequency), log10(rank)), 6) AS slope, round(regr_r2(log10(frequency), log10(rank)), 6) AS r2 FROM rk",
)
_add("hapax", lambda s, p: corpus.hapax(_frequencies(s, p)).withColumn("share", F.round("share", 6)), f"WITH {_FREQ} SELECT count(*) FILTER (WHERE frequency = 1) AS hapax, round(count(*) FILTER (WHERE frequency = 1) / count(*), 6) AS share FROM fr")


def _relevance(spark: SparkSession, sf: str) -> DataFrame:
    """A ranking of all logged results by document id, the order that Boolean results have, against those logged among the
    first ten."""
    logged = read_table(spark, sf, "search_results").where("doc_id IS NOT NULL").select(F.col("search_id").alias("query_id"), "doc_id", "relevance")
    judged = logged.where("relevance >= 0.1").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("gain"))
    ranked = logged.select("query_id", "doc_id").distinct().select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")).alias("rank"))
    out = corpus.relevance_measures(ranked, judged)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_add(
    "relevance_measures",
    _relevance,
    """WITH l AS (SELECT * FROM search_results WHERE doc_id IS NOT NULL), j AS (SELECT search_id, doc_id, max(relevance) AS gain FROM l WHERE relevance >= 0.1 GROUP BY ALL),
    rkd AS (SELECT search_id, doc_id, row_number() OVER (PARTITION BY search_id ORDER BY doc_id) AS rank FROM (SELECT DISTINCT search_id, doc_id FROM l)),
    i AS (SELECT search_id, count(*) AS rel, sum(gain / log2(i + 1)) FILTER (WHERE i <= 10) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY gain DESC, doc_id) AS i FROM j) GROUP BY 1),
    x AS (SELECT search_id, rank, gain, row_number() OVER (PARTITION BY search_id ORDER BY rank) AS hit FROM rkd JOIN j USING (search_id, doc_id)),
    h AS (SELECT search_id, count(*) FILTER (WHERE rank <= 10) AS h10, count(*) FILTER (WHERE rank <= 100) AS h100, sum(hit / rank) AS ap, sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg FROM x GROUP BY 1)
    SELECT round(avg(coalesce(h10, 0) / 10), 6) AS p10, round(avg(coalesce(h100, 0) / rel), 6) AS recall100, round(avg(coalesce(ap, 0) / rel), 6) AS map, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg10 FROM i LEFT JOIN h USING (search_id)""",
)

# ---- crawl
_PAGES = "u AS (SELECT DISTINCT url, source FROM crawl_store WHERE url IS NOT NULL)"


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "crawl_store").where("url IS NOT NULL").select("url", "source").distinct()


def _normal(x: str) -> str:
    rest = f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*[^?#;]*)', 1)"
    return f"(lower(regexp_extract({x}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace({rest}, '/+$', ''))"


_HOST_SQL = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_add("url_normalize", lambda s, p: _urls(s, p).select("url", url.normalize_url(F.col("url")).alias("normal")).distinct(), f"WITH {_PAGES} SELECT DISTINCT url, {_normal('url')} AS normal FROM u")


def _configured(spark: SparkSession, sf: str) -> DataFrame:
    config = read_table(spark, sf, "source_config").select(F.lower(F.trim("name")).alias("k"), url.domain(F.col("base_url")).alias("base"), "article_patterns")
    return _urls(spark, sf).withColumn("k", F.lower(F.trim("source"))).join(config, "k")


_CONFIG = f"{_PAGES}, cfg AS (SELECT lower(trim(name)) AS k, regexp_extract(base_url, '//([^/?#]*)', 1) AS base, article_patterns FROM source_config), uc AS (SELECT u.*, cfg.* FROM u JOIN cfg ON lower(trim(u.source)) = cfg.k)"
_ASSET_SQL = " OR ".join(f"ends_with(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#;]*)', 1)), '{e}')" for e in url.ASSET_ENDINGS)
_add("url_valid", lambda s, p: _configured(s, p).select("url", url.is_valid_url(F.col("url"), F.col("base")).alias("valid")).distinct(), f"WITH {_CONFIG} SELECT DISTINCT url, {_HOST_SQL} = '' OR (contains({_HOST_SQL}, base) AND NOT ({_ASSET_SQL}) AND regexp_matches(lower(url), '^https?://')) AS valid FROM uc")
_PARTS_SQL = " OR ".join(f"contains(lower(url), '{x}')" for x in url.ARTICLE_PARTS)
_add(
    "url_article",
    lambda s, p: _configured(s, p).select("url", url.is_article_url(F.col("url"), F.col("article_patterns")).alias("article")).distinct(),
    f"WITH {_CONFIG} SELECT DISTINCT url, ({_PARTS_SQL}) OR coalesce(len(list_filter(article_patterns, lambda x: contains(lower(url), x))) > 0, false) AS article FROM uc",
)
_add(
    "title_from_url",
    lambda s, p: _urls(s, p).select("url", url.title_from_url(F.col("url")).alias("title")).distinct(),
    f"""WITH {_PAGES}, w AS (SELECT DISTINCT url, replace(replace(list_last(string_split(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)', 1), '^/+|/+$', '', 'g'), '/')), '-', ' '), '_', ' ') AS w FROM u)
    SELECT url, CASE WHEN len(regexp_extract_all(w, '[^ ]+')) > 1 THEN array_to_string(list_transform(string_split(lower(w), ' '), lambda x: upper(x[1]) || x[2:]), ' ') ELSE 'Статья с ' || {_HOST_SQL} END AS title FROM w""",
)
_LINKS_HTML = """<p><a class=x href=../about.html>up</a> <A HREF='near.html?x=1&amp;y=2'>near</A> <a href="/top/">top</a> <a href="#here">here</a>
<a name=n>n</a> <a href="//other.test/x">other</a> <a href="/look.jpg">look</a> <a href=\""""


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of a page at each stored address: to its parent folder, beside it, to the site's root and to itself."""
    pages = read_table(spark, sf, "crawl_store").where("url IS NOT NULL").select(ledger.page_key(F.col("url")).alias("page")).distinct()
    pages = pages.withColumn("html", F.concat(F.lit(_LINKS_HTML), "page", F.lit('?a=1#f">self</a>')))
    return crawl.links(pages, F.col("html"), url.domain(F.col("page")), F.col("page")).select("page", "link")


_add(
    "link_extract",
    _links,
    """WITH pg AS (SELECT DISTINCT @PAGE@ AS page FROM crawl_store WHERE url IS NOT NULL),
    o AS (SELECT page, regexp_extract(page, '^[A-Za-z]+://[^/]*', 0) AS origin, string_split(regexp_extract(page, '^[A-Za-z]+://[^/]*(.*)$', 1), '/') AS parts FROM pg),
    q AS (SELECT page, origin, array_to_string(parts[: len(parts) - 1], '/') AS dir, array_to_string(parts[: greatest(len(parts) - 2, 0)], '/') AS above FROM o)
    SELECT page, origin || above || '/about.html' AS link FROM q UNION SELECT page, origin || dir || '/near.html' FROM q UNION SELECT page, origin || '/top' FROM q UNION SELECT page, page FROM q""",
)


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus as pages: each text as the larger of two articles between page parts, read back from the html."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    parts = ["<html><head><title>", safe("title"), "</title><script>var x = 1;</script></head><body><nav>Menu Home</nav><article>x</article><article><p>", safe("content"), "</p><footer>Contact</footer></article></body></html>"]
    page = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    read = crawl.articles(_docs(spark, sf).select("doc_id", page.alias("html")))
    return read.select("doc_id", "title", F.md5("content").alias("content_md5"))


_SPACE_SQL = r"[\s\p{Z}\x1c-\x1f\x{85}]+"
_TOPIC_SQL = " + ".join(f"CAST(contains(lower(c), '{k}') AS INTEGER)" for k in text.TOPIC_KEYWORDS)
_LONG_SQL = r"len(regexp_extract_all(c, '[^ \t\n\r\f\v]+')) >= 200"
_add(
    "article_extract",
    _articles,
    f"""WITH {_D}, a AS (SELECT doc_id, title, trim(regexp_replace(content, '{_SPACE_SQL}', ' ', 'g')) AS c FROM d)
    SELECT doc_id, regexp_replace(title, '^{_SPACE_SQL}|{_SPACE_SQL}$', '', 'g') AS title, md5(c) AS content_md5 FROM a WHERE {_LONG_SQL} AND {_TOPIC_SQL} >= 3""",
)


def _categories(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of categories - root, sources, the corpus's categories - down to its documents, with ways back to the root;
    one of the branches is a disambiguation."""
    low = read_table(spark, sf, "documents").select("doc_id", F.lower(F.trim("source")).alias("s"), "category", "title").where("s IS NOT NULL AND category IS NOT NULL")
    name = F.concat("s", F.when(F.col("s") == "loomwiki", " (Disambiguation)").otherwise(""))
    none, yes = F.lit(None).cast("bigint").alias("pageid"), F.lit(True).alias("is_category")
    leaf = F.concat("s", F.lit("/"), "category")
    branches = low.select(F.lit("root").alias("category"), name.alias("title"), none, yes).distinct()
    leaves = low.select(name.alias("category"), leaf.alias("title"), none, yes).distinct()
    back = leaves.select(F.col("title").alias("category"), F.lit("root").alias("title"), "pageid", "is_category")
    articles = low.select(leaf.alias("category"), "title", F.col("doc_id").alias("pageid"), F.lit(False).alias("is_category"))
    return crawl.categories(branches.unionByName(leaves).unionByName(back).unionByName(articles), ["root", "missing"])


_add("category_articles", _categories, "SELECT DISTINCT doc_id AS pageid FROM documents WHERE lower(trim(source)) <> 'loomwiki' AND category IS NOT NULL")


def _wiki_address(title: str) -> Column:
    return F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))


def _wiki(spark: SparkSession, sf: str) -> DataFrame:
    """The newest content of every stored title that has a page number replaces what the store held, whatever its hash."""
    rows = read_table(spark, sf, "crawl_store").where("pageid IS NOT NULL AND title IS NOT NULL AND content <> ''")
    newest = rows.groupBy("title").agg(F.max(F.struct("last_crawled", "rec_id", "content", "pageid")).alias("n")).select("title", "n.content", "n.pageid")
    first = rows.groupBy("title").agg(F.min(F.struct("last_crawled", "rec_id", "content")).alias("o"), F.count_distinct("rec_id").alias("states")).where("states > 1")
    none = F.lit(None).cast("timestamp").alias("last_modified")
    old = first.select(_wiki_address("title").alias("url"), "title", "o.content", F.md5("o.content").alias("content_hash"), F.lit("Wikipedia").alias("source"), F.lit(0).alias("word_count"), F.col("o.last_crawled").alias("first_crawled"), "o.last_crawled", F.lit(4).alias("update_count"), none)
    out = crawl.upsert(old, crawl.wiki_pages(newest), F.lit(_NOW).cast("timestamp"), compare_hash=False)
    return out.select("url", "action", "content_hash", F.col("update_count").cast("bigint").alias("update_count"))


_NOW = "2025-07-01 00:00:00"


def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    """All states of all pages against a store that holds each page's first state, where that had been updated before."""
    rows = read_table(spark, sf, "crawl_store").where("url IS NOT NULL AND content IS NOT NULL AND content <> ''").withColumn("url", ledger.page_key(F.col("url")))
    first = rows.groupBy("url").agg(F.min(F.struct("last_crawled", "rec_id", "title", "content", "source", "word_count", "first_crawled", "update_count", "last_modified")).alias("a")).where("a.update_count > 0")
    old = first.select("url", "a.title", "a.content", F.md5("a.content").alias("content_hash"), "a.source", "a.word_count", "a.first_crawled", "a.last_crawled", "a.update_count", "a.last_modified")
    new = rows.select("url", "title", "content", "source", F.col("last_crawled").alias("crawled_at"))
    out = crawl.upsert(old, new, F.lit(_NOW).cast("timestamp"))
    return out.select("url", "action", "content_hash", F.col("update_count").cast("bigint").alias("update_count"), F.unix_timestamp("last_crawled").alias("crawled"))


_add(
    "content_hash_upsert",
    _upsert,
    """WITH r AS (SELECT *, @PAGE@ AS u FROM crawl_store WHERE url IS NOT NULL AND content IS NOT NULL AND content <> ''),
    o AS (SELECT u, md5(arg_min(content, (last_crawled, rec_id))) AS h, min(last_crawled) AS t, arg_min(update_count, (last_crawled, rec_id)) AS c FROM r GROUP BY 1),
    n AS (SELECT u, md5(arg_max(content, (last_crawled, content))) AS h, max(last_crawled) AS t FROM r GROUP BY 1),
    x AS (SELECT n.u AS url, CASE WHEN o.u IS NULL THEN 'inserted' WHEN floor((epoch(n.t) - epoch(o.t)) / 86400) < 30 THEN 'skipped' WHEN o.h = n.h THEN 'touched' ELSE 'updated' END AS action, o.h AS oh, n.h AS nh, o.t AS ot, n.t AS nt, c
          FROM n LEFT JOIN (SELECT * FROM o WHERE c > 0) o ON o.u = n.u)
    SELECT url, action, CASE WHEN action IN ('inserted', 'updated') THEN nh ELSE oh END AS content_hash,
           CAST(CASE action WHEN 'inserted' THEN 0 WHEN 'updated' THEN c + 1 ELSE c END AS BIGINT) AS update_count, CAST(floor(epoch(CASE WHEN action = 'skipped' THEN ot ELSE nt END)) AS BIGINT) AS crawled FROM x""",
)


def _frontier(spark: SparkSession, sf: str) -> DataFrame:
    """From the configured base urls over the site's sections to its pages."""
    starts = read_table(spark, sf, "source_config").select(F.col("base_url").alias("url"))
    return crawl.frontier(_edges(spark, sf), starts, 3).select("url", F.col("depth").cast("int").alias("depth"))


_add(
    "frontier_bfs",
    _frontier,
    """WITH RECURSIVE pg AS (SELECT DISTINCT @PAGE@ AS target FROM crawl_store WHERE url IS NOT NULL), dn AS (SELECT regexp_extract(target, '^(.*)/[^/]*$', 1) AS source, target FROM pg),
    ed AS (SELECT * FROM dn UNION SELECT regexp_extract(source, '^(.*)/[^/]*$', 1), source FROM dn),
    bfs AS (SELECT DISTINCT base_url AS url, 0 AS depth FROM source_config UNION SELECT ed.target, depth + 1 FROM bfs JOIN ed ON ed.source = bfs.url WHERE depth < 3)
    SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM bfs GROUP BY 1""",
)
_WIKI_SQL = "'https://en.wikipedia.org/wiki/' || replace(title, ' ', '_') AS url"
_add(
    "wiki_upsert",
    _wiki,
    f"""WITH r AS (SELECT * FROM crawl_store WHERE pageid IS NOT NULL AND title IS NOT NULL AND content <> ''),
    n AS (SELECT {_WIKI_SQL}, arg_max(content, (last_crawled, rec_id)) AS c FROM r GROUP BY title),
    g AS (SELECT url, md5(c) AS h FROM n WHERE {_LONG_SQL} AND {_TOPIC_SQL} >= 3),
    o AS (SELECT {_WIKI_SQL}, md5(arg_min(content, (last_crawled, rec_id))) AS h, min(last_crawled) AS t FROM r GROUP BY title HAVING count(DISTINCT rec_id) > 1),
    x AS (SELECT coalesce(o.url, g.url) AS url, CASE WHEN o.url IS NULL THEN 'inserted' WHEN g.url IS NULL THEN 'kept' WHEN floor((epoch(TIMESTAMP '{_NOW}') - epoch(t)) / 86400) < 30 THEN 'skipped' ELSE 'updated' END AS action,
                 o.h AS oh, g.h AS gh FROM o FULL JOIN g ON o.url = g.url)
    SELECT url, action, CASE WHEN action IN ('inserted', 'updated') THEN gh ELSE oh END AS content_hash, CAST(CASE action WHEN 'inserted' THEN 0 WHEN 'updated' THEN 5 ELSE 4 END AS BIGINT) AS update_count FROM x""",
)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """From a site's root over its sections to its pages."""
    pages = read_table(spark, sf, "crawl_store").where("url IS NOT NULL").select(ledger.page_key(F.col("url")).alias("target")).distinct()
    down = pages.select(F.regexp_extract("target", "^(.*)/[^/]*$", 1).alias("source"), "target")
    return down.unionByName(down.select(F.regexp_extract("source", "^(.*)/[^/]*$", 1).alias("s"), F.col("source").alias("target")).distinct().select(F.col("s").alias("source"), "target"))


def _all_sites(spark: SparkSession, sf: str) -> DataFrame:
    sites = read_table(spark, sf, "source_config").withColumn("start_urls", F.array("base_url"))
    return crawl.crawl_sites(sites, _edges(spark, sf), 3, most_articles=20).select("place", "name", "url", "depth")


_add(
    "crawl_all_sites",
    _all_sites,
    f"""WITH RECURSIVE pg AS (SELECT DISTINCT @PAGE@ AS target FROM crawl_store WHERE url IS NOT NULL), dn AS (SELECT regexp_extract(target, '^(.*)/[^/]*$', 1) AS source, target FROM pg),
    ed AS (SELECT * FROM dn UNION SELECT regexp_extract(source, '^(.*)/[^/]*$', 1), source FROM dn),
    bfs AS (SELECT DISTINCT name, base_url AS url, 0 AS depth FROM source_config UNION SELECT name, ed.target, depth + 1 FROM bfs JOIN ed ON ed.source = bfs.url WHERE depth < 3),
    f AS (SELECT name, url, min(depth) AS depth FROM bfs GROUP BY ALL),
    cfg AS (SELECT name, regexp_extract(base_url, '//([^/?#]*)', 1) AS base, article_patterns, row_number() OVER (ORDER BY coalesce(priority, 3), name) AS place FROM source_config),
    a AS (SELECT place, name, url, depth, row_number() OVER (PARTITION BY name ORDER BY depth, url) AS n FROM f JOIN cfg USING (name)
          WHERE ({_HOST_SQL} = '' OR (contains({_HOST_SQL}, base) AND NOT ({_ASSET_SQL}) AND regexp_matches(lower(url), '^https?://')))
            AND (({_PARTS_SQL}) OR coalesce(len(list_filter(article_patterns, lambda x: contains(lower(url), x))) > 0, false)))
    SELECT CAST(place AS INTEGER) AS place, name, url, CAST(depth AS INTEGER) AS depth FROM a WHERE n <= 20""",
)
_add("sources_by_priority", lambda s, p: with_ordinal(read_table(s, p, "source_config").select("name", "priority"), [F.coalesce("priority", F.lit(3)), F.col("name")], "place", 1).select("place", "name"), "SELECT row_number() OVER (ORDER BY coalesce(priority, 3), name) AS place, name FROM source_config")


# ---- new or changed pages
def _ledger_states(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.page_states(*(read_table(spark, sf, t) for t in ("crawl_store", "processed_docs", "crawl_runs")))


def _page_sql(column: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({column}), '[?#][\\s\\S]*$', ''), '/+$', '')"
    origin = f"regexp_extract({bare}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    return f"lower({origin}) || substr({bare}, length({origin}) + 1)"


_STATES = f"""
    newest AS (SELECT rec_id, item, version FROM (
        SELECT rec_id, {_page_sql("url")} AS item, coalesce(nullif(lower(trim(content_hash)), ''), md5(content)) AS version,
               row_number() OVER (PARTITION BY {_page_sql("url")} ORDER BY last_crawled DESC NULLS LAST, rec_id DESC) AS r
        FROM crawl_store WHERE url IS NOT NULL) WHERE r = 1),
    done AS (SELECT item, version FROM (
        SELECT {_page_sql("p.url")} AS item, lower(p.content_hash) AS version,
               row_number() OVER (PARTITION BY {_page_sql("p.url")} ORDER BY p.run_id DESC, lower(p.content_hash) DESC NULLS LAST) AS r
        FROM processed_docs p JOIN (SELECT DISTINCT run_id FROM crawl_runs WHERE status = 'success') USING (run_id)) WHERE r = 1),
    states AS (SELECT n.rec_id, n.item,
                      CASE WHEN d.item IS NOT NULL AND n.version IS NOT DISTINCT FROM d.version THEN 'done' ELSE 'pending' END AS state
               FROM newest n LEFT JOIN done d USING (item))"""
_add("p5_found", lambda s, p: _ledger_states(s, p).where("state = 'pending'").select("rec_id"), f"WITH {_STATES} SELECT rec_id FROM states WHERE state = 'pending'")
_add("p5_ledger_states", lambda s, p: _ledger_states(s, p).select("rec_id", "item", "state"), f"WITH {_STATES} SELECT rec_id, item, state FROM states")
for _name in ("content_hash_upsert", "frontier_bfs", "link_extract", "crawl_all_sites"):
    SQL[_name] = SQL[_name].replace("@PAGE@", _page_sql("url"))
