"""The index: documents -> forward table, postings, inverted table, statistics; saving and looking up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import stemmer, tokenizer
from heddle.operators.numbering import with_ordinal
from heddle.session import spread, write_stage

UNTITLED = "Untitled Document"


def document_rows(docs: DataFrame) -> DataFrame:
    """Rows of the engine's document table - id, url, title, content, source, word_count - with defaults for what is
    missing: empty strings and 0. Accepts text for content and doc_id for id."""
    have = set(docs.columns)
    content = "content" if "content" in have else "text"
    key = F.col("doc_id") if "doc_id" in have else F.col("id")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    count = F.coalesce(F.col("word_count"), F.lit(0)) if "word_count" in have else F.lit(0)
    return docs.select(key.alias("key"), text("id").alias("id"), text("url").alias("url"), text("title").alias("title"), text(content).alias("content"), text("source").alias("source"), count.cast("int").alias("word_count"))


def document_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, token, tf): counts of the unstemmed tokens of each document.

    Matches are counted as they stand, and made tokens afterwards: once for each different match of a document.
    """
    found = spread(docs.select("doc_id", "content")).select("doc_id", F.explode(tokenizer.matches(F.col("content"))).alias("m"))
    counts = found.groupBy("doc_id", "m").agg(F.count("*").alias("n"))
    return counts.select("doc_id", tokenizer.token(F.col("m")).alias("token"), "n").where("token IS NOT NULL").groupBy("doc_id", "token").agg(F.sum("n").alias("tf"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """(token, stem): each distinct token is stemmed once."""
    return counts.select("token").distinct().withColumn("stem", stemmer.stem(F.col("token")))


def postings(counts: DataFrame) -> DataFrame:
    """(term, doc_id, tf) over stems of 2 to 50 characters.

    The stemmed vocabulary is written before it is filtered: the condition on the stem would otherwise be pushed below
    the join, and every count would be stemmed.
    """
    stems = write_stage(vocabulary(counts), "vocabulary").where(F.length("stem").between(tokenizer.MIN_LENGTH, tokenizer.MAX_LENGTH))
    return counts.join(stems, "token").groupBy(F.col("stem").alias("term"), "doc_id").agg(F.sum("tf").alias("tf"))


def inverted(posted: DataFrame) -> DataFrame:
    """(term, df, occurrences, doc_ids): the postings as sorted arrays, for exchange; queries run on the long form."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"), F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def inverted_blocks(posted: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(term, block, df, occurrences, doc_ids): like ``inverted``, with the list of a frequent term in blocks of ``block``
    consecutive documents, so that no row and no task holds a list over all documents."""
    of = F.floor(F.col("doc_id") / F.lit(block)).cast("bigint").alias("block")
    return posted.groupBy("term", of).agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"), F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@dataclass
class Index:
    """forward: doc_id, id, url, title, doc_length, checksum; postings: term, doc_id, tf."""

    forward: DataFrame
    postings: DataFrame

    def find_term(self, term: str) -> DataFrame:
        """Sorted document ids of one term; empty for an unknown one. On a saved index only the term's row groups are read."""
        return self.postings.where(F.col("term") == term).select("doc_id").orderBy("doc_id")

    def document_info(self, doc_id: int) -> DataFrame:
        """The forward row of one document; an id out of range raises IndexError."""
        row = self.forward.where(F.col("doc_id") == doc_id)
        if row.isEmpty():
            raise IndexError("Document ID out of range")
        return row

    def statistics(self) -> DataFrame:
        """One row: documents, terms, postings, mean term length over the vocabulary, mean document length."""
        terms = self.postings.groupBy("term").agg(F.count("*").alias("df")).agg(F.count("*").alias("total_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("total_postings"), F.coalesce(F.avg(F.length("term")), F.lit(0.0)).alias("avg_term_length"))
        docs = self.forward.agg(F.count("*").alias("total_documents"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_doc_length"))
        return docs.join(F.broadcast(terms), F.lit(True))  # one row each

    def save(self, path: str) -> None:
        """Two parquet tables; postings sorted by term, so that a lookup prunes by the files' minima and maxima."""
        self.forward.sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/forward")
        self.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(f"{path}/forward"), spark.read.parquet(f"{path}/postings"))


def build_index(documents: DataFrame) -> Index:
    """The index of a document table; doc_id is the position in order of the documents' key. Missing texts count as empty.

    Texts are read where they lie and never shuffled: the numbering sorts keys, urls and titles, and the token counts
    get their document's number by key and fingerprint. Documents that equal each other in everything have numbers of
    their own; their counts, which come together, are divided among them.
    """
    rows = document_rows(documents)
    rows = rows.withColumn("_print", F.xxhash64(*[c for c in rows.columns if c != "key"]))
    named = with_ordinal(rows.select("key", "_print", "id", "url", "title"), [F.col("key"), F.col("_print")], "doc_id")
    found = document_tokens(rows.select(F.struct("key", "_print").alias("doc_id"), "content"))
    ids = named.select(F.struct("key", "_print").alias("_doc"), "doc_id", F.count("*").over(Window.partitionBy("key", "_print")).alias("_copies"))
    numbered = found.withColumnRenamed("doc_id", "_doc").join(ids, "_doc").select("doc_id", "token", (F.col("tf") / F.col("_copies")).cast("bigint").alias("tf"))
    counts = write_stage(numbered, "counts")  # read twice: for the vocabulary and for the postings
    posted = write_stage(postings(counts), "postings")
    lengths = posted.groupBy("doc_id").agg(F.count("*").alias("doc_length"))
    forward = named.select("doc_id", "id", "url", "title").join(lengths, "doc_id", "left")
    return Index(forward.select("doc_id", "id", "url", "title", F.coalesce("doc_length", F.lit(0)).alias("doc_length"), F.col("doc_id").alias("checksum")), posted)
