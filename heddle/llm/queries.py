"""Registered queries of the training-text operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import mixing, packing, page_body, quality, residue, site_lines, splitting, terms, tokens
from heddle.session import read_table, write_stage

_BLANKS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(160)"
_PAIRS = f"""
    pairs AS (SELECT term, doc, max(coalesce(f, 1)) AS f
              FROM (SELECT lower(trim(term, {_BLANKS})) AS term, unnest(doc_ids) AS doc,
                           unnest(coalesce(frequencies, list_transform(doc_ids, lambda x: 1))) AS f FROM inverted_index)
              WHERE term <> '' AND doc IS NOT NULL GROUP BY 1, 2),
    n AS (SELECT count(DISTINCT doc) AS n FROM pairs),
    d AS (SELECT term, count(*) AS df, sum(f) AS occ FROM pairs GROUP BY 1)"""


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "title", "text", "source")
    return quality.not_prose(docs, read_table(spark, sf, "common_words"))


def p1_profiles(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "title", "text", "source")
    return quality.profiles(write_stage(quality.statistics(docs, read_table(spark, sf, "common_words")), "statistics"))


def p1_figures(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "title", "text", "source")
    figures = quality.statistics(docs, read_table(spark, sf, "common_words"))
    return figures.select("doc_id", F.col("word_count").cast("bigint").alias("words"), F.round("mean_word_length", 4).alias("mean_word_length"), F.round("common_share", 4).alias("common_share"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return page_body.lines_outside_body(read_table(spark, sf, "crawl_store").select("rec_id", "url", "title", "content"))


def p2_bodies(spark: SparkSession, sf: str) -> DataFrame:
    store = read_table(spark, sf, "crawl_store").select("rec_id", "url", "title", "content")
    return page_body.main_body(store).select("rec_id", "body", "lines_cut", "strings_cut")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "url", "title", "source", "text")
    return residue.residue(docs).select("doc_id")


def p3_reasons(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "url", "title", "source", "text")
    return residue.residue(docs)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_marks(read_table(spark, sf, "inverted_index")).where("mark IS NOT NULL").select("term", "mark")


def p4_term_counts(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_marks(read_table(spark, sf, "inverted_index")).select("term", "df", "occurrences", "n_docs", F.coalesce("mark", F.lit("useful")).alias("mark"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return terms.distinctive_terms(read_table(spark, sf, "inverted_index")).select("doc_id", "term")


def p6_term_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = terms.weighted_terms(read_table(spark, sf, "inverted_index"))
    return w.select("term", "doc_id", "tf", "df", F.round("tf_idf", 4).alias("tf_idf"), F.round("weight", 4).alias("weight"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "text")
    return site_lines.repeated_lines(docs).select("doc_id", F.col("line_no").cast("int").alias("line_no"))


def p7_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "text")
    return site_lines.without_repeated_lines(docs).select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.col("lines_cut").cast("bigint").alias("lines_cut"))


def p7_stretches(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "text")
    return site_lines.without_repeated_text(docs).select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.col("stretches_cut").cast("bigint").alias("stretches_cut"))


_LINES = """
    lines AS (SELECT doc_id, source, line_no, line, trim(regexp_replace(regexp_replace(lower(line), '\\p{Nd}+', '0', 'g'), '[^\\p{L}\\p{Nd}]+', ' ', 'g'), ' ') AS norm
              FROM (SELECT doc_id, lower(trim(source)) AS source, unnest(string_split(text, chr(10))) AS line,
                           generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)),
    long AS (SELECT * FROM lines WHERE source IS NOT NULL AND length(regexp_replace(norm, '[^\\p{L}]', '', 'g')) >= 20),
    often AS (SELECT source, norm FROM long GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 4),
    cases AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM long JOIN often USING (source, norm))"""

def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return write_stage(tokens.sized(read_table(spark, sf, "documents").select("doc_id", "source", "text")), "sizes")


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_all(_sizes(spark, sf), read_table(spark, sf, "size_limits"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.report(p8_pack(spark, sf))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf), read_table(spark, sf, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf), read_table(spark, sf, "mix_targets"))[1]


def p10_split(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_documents(read_table(spark, sf, "documents").select("doc_id", "text"), read_table(spark, sf, "size_limits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_profiles": p1_profiles,
    "p1_figures": p1_figures,
    "p2_found": p2_found,
    "p2_bodies": p2_bodies,
    "p3_found": p3_found,
    "p3_reasons": p3_reasons,
    "p4_found": p4_found,
    "p4_term_counts": p4_term_counts,
    "p6_found": p6_found,
    "p6_term_weights": p6_term_weights,
    "p7_found": p7_found,
    "p7_cleaned": p7_cleaned,
    "p7_stretches": p7_stretches,
    "p8_pack": p8_pack,
    "p8_fill": p8_fill,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_split": p10_split,
}

SQL: dict[str, str] = {
    "p1_figures": """WITH c AS (SELECT list(DISTINCT lower(trim(word))) AS common FROM common_words WHERE word IS NOT NULL),
        w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{Nl}\\p{No}]+') AS words FROM documents WHERE doc_id IS NOT NULL)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS words, round(CASE WHEN len(words) > 0 THEN list_sum(list_transform(words, lambda x: length(x))) / len(words) ELSE 0 END, 4) AS mean_word_length,
               round(CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: list_contains(common, x))) / len(words) ELSE 0 END, 4) AS common_share FROM w, c""",
    "p4_found": f"""WITH {_PAIRS}
        SELECT term, CASE WHEN df < 3 THEN 'rare' ELSE 'common' END AS mark FROM d, n WHERE df < 3 OR 5 * df > n""",
    "p4_term_counts": f"""WITH {_PAIRS}
        SELECT term, CAST(df AS BIGINT) AS df, CAST(occ AS BIGINT) AS occurrences, CAST(n AS BIGINT) AS n_docs,
               CASE WHEN df < 3 THEN 'rare' WHEN 5 * df > n THEN 'common' ELSE 'useful' END AS mark FROM d, n""",
    "p6_found": f"""WITH {_PAIRS},
        s AS (SELECT doc, term, round(f * ln(n * 1.0 / df), 6) AS score FROM pairs JOIN d USING (term), n)
        SELECT doc AS doc_id, term
        FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, term) AS r FROM s) WHERE r = 1""",
    "p6_term_weights": f"""WITH {_PAIRS},
        s AS (SELECT term, doc, f, df, f * ln((1.0 + n) / (1 + df)) AS w FROM pairs JOIN d USING (term), n),
        l AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM s GROUP BY 1)
        SELECT term, doc AS doc_id, CAST(f AS BIGINT) AS tf, CAST(df AS BIGINT) AS df, round(w, 4) AS tf_idf,
               round(CASE WHEN norm > 0 THEN w / norm ELSE 0 END, 4) AS weight FROM s JOIN l USING (doc)""",
    "p7_found": f"WITH {_LINES} SELECT DISTINCT doc_id, line_no FROM cases",
    "p7_cleaned": f"""WITH {_LINES},
        kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE c.line_no IS NULL) AS t, count(c.line_no) AS cut
                 FROM lines l LEFT JOIN cases c ON l.doc_id = c.doc_id AND l.line_no = c.line_no GROUP BY 1)
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN CAST(coalesce(length(t), 0) AS BIGINT) END AS n_chars,
               CAST(coalesce(cut, 0) AS BIGINT) AS lines_cut FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
}
