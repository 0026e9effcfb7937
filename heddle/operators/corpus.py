"""Corpus statistics: sources, tokens, vocabulary, histograms, diversity, fits and relevance measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import tokenizer


def source_statistics(docs: DataFrame) -> DataFrame:
    """(source, documents, total_words, avg_words, min_words, max_words); a missing word_count counts as 0."""
    w = F.coalesce("word_count", F.lit(0)).cast("bigint")
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum(w).alias("total_words"), F.avg(w).alias("avg_words"), F.min(w).alias("min_words"), F.max(w).alias("max_words"))


def corpus_totals(docs: DataFrame) -> DataFrame:
    """One row: documents, words, words per document; no row for an empty corpus."""
    s = source_statistics(docs)
    total = s.agg(F.sum("documents").alias("total_documents"), F.sum("total_words").alias("total_words"))
    return total.where("total_documents > 0").withColumn("avg_words_per_doc", F.col("total_words") / F.col("total_documents"))


def token_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_size_chars, doc_size_kb, num_tokens, token_chars, avg_token_length) of each document; sizes in bytes."""
    rows = docs.select("doc_id", F.octet_length(F.coalesce("content", F.lit(""))).cast("bigint").alias("doc_size_chars"), F.explode(F.array(tokenizer.tokens(F.col("content")))).alias("t"))
    counted = rows.select("doc_id", "doc_size_chars", F.size("t").cast("bigint").alias("num_tokens"), tokenizer.total_chars(F.col("t")).alias("token_chars"))
    mean = F.when(F.col("num_tokens") > 0, F.col("token_chars") / F.col("num_tokens")).otherwise(0.0)
    return counted.withColumn("doc_size_kb", F.col("doc_size_chars") / 1024).withColumn("avg_token_length", mean)


def token_summary(stats: DataFrame, unique_tokens: Column) -> DataFrame:
    """One row over ``token_stats``: documents, tokens, unique tokens, mean length, kilobytes of token characters, tokens per kilobyte."""
    one = stats.agg(F.count("*").alias("documents"), F.coalesce(F.sum("num_tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("token_chars"), F.lit(0)).alias("chars"))
    kb = F.col("chars") / 1024
    return one.select("documents", "total_tokens", unique_tokens.alias("unique_tokens"), F.when(F.col("total_tokens") > 0, F.col("chars") / F.col("total_tokens")).otherwise(0.0).alias("avg_token_length"), kb.alias("token_kb"), F.when(kb > 0, F.col("total_tokens") / kb).otherwise(0.0).alias("tokens_per_kb"))


def vocabulary_reduction(vocabulary: DataFrame) -> DataFrame:
    """One row: distinct tokens, distinct stems, reduction in per cent."""
    one = vocabulary.agg(F.count_distinct("token").alias("before"), F.count_distinct("stem").alias("after"))
    return one.withColumn("reduction", F.when(F.col("before") > 0, (1 - F.col("after") / F.col("before")) * 100).otherwise(0.0))


def stemming_table(frequencies: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(original, stemmed, original_count, stemmed_count): each token with its stem and both frequencies."""
    both = frequencies.join(vocabulary, "token")
    per_stem = both.groupBy("stem").agg(F.sum("frequency").alias("stemmed_count"))
    return both.join(per_stem, "stem").select(F.col("token").alias("original"), F.col("stem").alias("stemmed"), F.col("frequency").alias("original_count"), "stemmed_count")


def top_share(frequencies: DataFrame, n: int = 20) -> DataFrame:
    """(rank, token, frequency, share) of the n most frequent tokens."""
    total = frequencies.agg(F.sum("frequency")).scalar()
    top = frequencies.orderBy(F.col("frequency").desc(), "token").limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.col("frequency").desc(), "token")).cast("bigint").alias("rank"), "token", "frequency", (F.col("frequency") * 100.0 / total).alias("share"))


def histogram(value: Column, edges: list[int]) -> Column:
    """A label for the interval of an integer value: up to each edge, and above the last."""
    low, label = 0, None
    for edge in edges:
        name = f"{low}-{edge}" if low != edge else str(edge)
        label = F.when(value <= edge, name) if label is None else label.when(value <= edge, name)
        low = edge + 1
    return label.otherwise(f"{low}+")


def lexical_diversity(frequencies: DataFrame) -> DataFrame:
    """One row: unique over total tokens, mean and standard deviation of token length by occurrence."""
    n = F.sum("frequency")
    length = F.length("token")
    mean = F.sum(length * F.col("frequency")) / n
    square = F.sum(length * length * F.col("frequency")) / n
    return frequencies.agg((F.count("*") / n).alias("diversity"), mean.alias("mean_length"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("stddev_length"))


def entropy(frequencies: DataFrame) -> DataFrame:
    """One row: entropy of the token distribution in bits, and perplexity."""
    n = F.sum("frequency").cast("double")
    bits = F.log2(n) - F.sum(F.col("frequency") * F.log2(F.col("frequency"))) / n
    return frequencies.agg(bits.alias("entropy")).withColumn("perplexity", F.pow(F.lit(2.0), F.col("entropy")))


def loglog_fit(zipf_table: DataFrame) -> DataFrame:
    """One row: slope and R2 of log frequency over log rank."""
    return zipf_table.agg(F.regr_slope("log_freq", "log_rank").alias("slope"), F.regr_r2("log_freq", "log_rank").alias("r2"))


def hapax(frequencies: DataFrame) -> DataFrame:
    """One row: tokens that occur once, and their share of the vocabulary."""
    once = F.count_if(F.col("frequency") == 1)
    return frequencies.agg(once.alias("hapax"), F.when(F.count("*") > 0, once / F.count("*")).otherwise(0.0).alias("share"))


def relevance_measures(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: mean P@10, recall@100, average precision and NDCG@10 over the queries of ``judged``.

    ``ranked`` has query_id, doc_id and rank (from 1), ``judged`` query_id, doc_id and gain (over 0 is relevant).
    """
    wanted = judged.where("gain > 0").groupBy("query_id", "doc_id").agg(F.max("gain").alias("gain"))
    totals = wanted.groupBy("query_id").agg(F.count("*").alias("relevant"))
    ideal = wanted.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("gain").desc(), "doc_id"))).where("i <= 10").groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("i") + 1)).alias("ideal"))
    hits = ranked.join(wanted, ["query_id", "doc_id"]).withColumn("hit", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    per = hits.groupBy("query_id").agg(F.count_if(F.col("rank") <= 10).alias("h10"), F.count_if(F.col("rank") <= 100).alias("h100"), F.sum(F.col("hit") / F.col("rank")).alias("ap"), F.sum(F.when(F.col("rank") <= 10, F.col("gain") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    all_ = totals.join(ideal, "query_id").join(per, "query_id", "left").fillna(0)
    return all_.agg(F.avg(F.col("h10") / 10).alias("p10"), F.avg(F.col("h100") / F.col("relevant")).alias("recall100"), F.avg(F.col("ap") / F.col("relevant")).alias("map"), F.avg(F.col("dcg") / F.col("ideal")).alias("ndcg10"))
