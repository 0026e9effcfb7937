"""Term frequencies, ranks and their fits to Zipf's and Mandelbrot's laws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.numbering import Desc, with_ordinal

#: Ranks that the Zipf constant is fitted over.
CONSTANT_RANKS = 1000


def term_frequency(counts: DataFrame) -> DataFrame:
    """(token, frequency) over all documents, from per-document counts."""
    return counts.groupBy("token").agg(F.sum("tf").alias("frequency"))


def ranked(frequencies: DataFrame) -> DataFrame:
    """``frequencies`` with rank 1..n by falling frequency, equal ones in order of token."""
    return with_ordinal(frequencies, [Desc(F.col("frequency")), F.col("token")], "rank", 1)


def zipf_constant(ranks: DataFrame, first: int = CONSTANT_RANKS) -> DataFrame:
    """One row: the frequencies of the first ranks over the sum of their reciprocals; 0 without ranks."""
    head = ranks.where(F.col("rank") <= first)
    return head.agg(F.coalesce(F.sum("frequency") / F.sum(1.0 / F.col("rank")), F.lit(0.0)).alias("zipf_constant"))


def zipf_table(ranks: DataFrame) -> DataFrame:
    """(rank, frequency, log_rank, log_freq, zipf_prediction), logarithms to base 10."""
    c = zipf_constant(ranks).scalar()
    return ranks.select("rank", "frequency", F.log10("rank").alias("log_rank"), F.log10("frequency").alias("log_freq"), F.log10(c / F.col("rank")).alias("zipf_prediction"))


def mandelbrot(rank: Column, c: float, b: float, alpha: float) -> Column:
    """c / (rank + b) ** alpha."""
    return F.lit(float(c)) / F.pow(rank + F.lit(float(b)), F.lit(float(alpha)))


def summary(frequencies: DataFrame) -> DataFrame:
    """One row: total and unique tokens."""
    return frequencies.agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_tokens"), F.count("*").alias("unique_tokens"))


def save_csv(table: DataFrame, path: str) -> None:
    """The Zipf table as CSV with a header, numbers of 6 significant digits."""
    digits = [F.format_string("%.6g", F.col(c)).alias(c) for c in ("log_rank", "log_freq", "zipf_prediction")]
    table.select("rank", "frequency", *digits).orderBy("rank").write.mode("overwrite").option("header", True).csv(path)
