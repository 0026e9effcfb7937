import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from heddle import cli, session
from heddle.operators import corpus, numbering, zipf
from heddle.operators.index import build_index
from heddle.sources import documents, indexfile
from heddle.streaming.upserts import VersionedStore, stream_upserts

DOCS = [{"id": "a", "title": "One", "content": "red silk coat", "url": "u1"}, {"id": "b", "content": "wool coat", "source": "s", "word_count": 2}, {"id": "c", "title": "Three", "content": None}]


def test_json_sources(spark, tmp_path):
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, DOCS)))
    (tmp_path / "a.json").write_text(json.dumps(DOCS))
    lines = documents.read_json(spark, str(tmp_path / "l.json"))
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, documents.read_json(spark, str(tmp_path / "a.json"), array=True).collect()))
    assert documents.count_documents(lines) == 3 and lines.where("id = 'b'").first().title == ""
    (tmp_path / "e.json").write_text("")
    with pytest.raises(ValueError):
        documents.read_json(spark, str(tmp_path / "e.json"))
    with pytest.raises(FileNotFoundError):
        documents.read_json(spark, str(tmp_path / "none.json"))
    lines.write.parquet(str(tmp_path / "d.parquet"))
    assert [r.id for r in documents.fetch_documents(spark, str(tmp_path / "d.parquet"), 2).orderBy("id").collect()] == ["a", "b"]
    (tmp_path / "q.txt").write_text("coat\n\n  \nsilk && red\n")
    assert documents.read_queries(str(tmp_path / "q.txt")) == ["coat", "silk && red"]
    assert documents.read_queries("coat || silk") == ["coat || silk"]


def test_index_file(spark, tmp_path):
    docs = spark.createDataFrame([(1, "i1", "https://u/" + "x" * 300, "t", "red silk coat"), (2, "i2", "", "", None)], "doc_id bigint, id string, url string, title string, text string")
    index = build_index(docs)
    path = str(tmp_path / "ix.bin")
    indexfile.write(index, path)
    with open(path, "rb") as file:
        assert indexfile.read_header(file) == {"documents": 2, "terms": 3, "forward": 40, "inverted": indexfile.read_header(open(path, "rb"))["inverted"]}
        file.seek(0)
        assert file.read(4) == b"FASH"
    back = indexfile.read(spark, path)
    assert sorted(map(tuple, back.forward.select(index.forward.columns).collect())) == sorted(map(tuple, index.forward.collect()))
    assert sorted(map(tuple, back.postings.collect())) == sorted(map(tuple, index.postings.collect()))
    assert [r.doc_id for r in back.find_term("silk").collect()] == [0] and back.find_term("none").count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = indexfile.read(spark, path)
        assert [r.doc_id for r in pushed.find_term("silk").collect()] == [0] and pushed.find_term("none").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    (tmp_path / "bad").write_bytes(b"x" * 50)
    with pytest.raises(indexfile.IndexFileError):
        indexfile.read_header(open(tmp_path / "bad", "rb"))
    with pytest.raises(indexfile.IndexFileError):
        indexfile._string("x" * 256, False)


def test_stages_are_kept_in_the_shared_folder(spark):
    stage = session.write_stage(spark.range(3), "x")
    assert stage.inputFiles()[0].startswith("file://" + session.shared_dir(spark)) and stage.count() == 3
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.clear_stages(spark) > 0 and session.clear_stages(spark) == 0


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    assert all(r.v == r.n for r in numbering.with_ordinal(df, [F.col("v")], "n").collect())
    assert all(r.n == 1000 - r.v for r in numbering.with_ordinal(df, [numbering.Desc(F.col("v"))], "n", 1).collect())
    assert numbering.with_ordinal(df.limit(0), [F.col("v")], "n").count() == 0


def test_zipf_and_corpus(spark, tmp_path):
    freq = spark.createDataFrame([("a", 8), ("b", 4), ("c", 4), ("d", 1)], "token string, frequency bigint")
    ranks = zipf.ranked(freq)
    assert [(r["rank"], r.token) for r in ranks.orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert abs(zipf.zipf_constant(ranks).first()[0] - 17 / (1 + 1 / 2 + 1 / 3 + 1 / 4)) < 1e-9
    assert zipf.zipf_constant(ranks.limit(0)).first()[0] == 0
    zipf.save_csv(zipf.zipf_table(ranks), str(tmp_path / "z"))
    assert spark.read.option("header", True).csv(str(tmp_path / "z")).columns == ["rank", "frequency", "log_rank", "log_freq", "zipf_prediction"]
    assert abs(corpus.entropy(freq).first().entropy - 1.7344) < 1e-3
    assert corpus.hapax(freq).first().hapax == 1
    docs = spark.createDataFrame([("s", 3), ("s", None), (None, 5)], "source string, word_count int")
    stats = documents.write_statistics(corpus.corpus_totals(docs), corpus.source_statistics(docs), str(tmp_path / "s.json"), str(tmp_path / "r.txt"))
    assert (stats["total_documents"], stats["total_words"]) == (3, 8) and json.load(open(tmp_path / "s.json"))["total_words"] == 8
    assert documents.write_statistics(corpus.corpus_totals(docs.limit(0)), corpus.source_statistics(docs), "x", "y") is None


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, DOCS)))
    (tmp_path / "q.txt").write_text("coat\nnone\n")
    at = ["--index", str(tmp_path / "ix")]
    assert cli.main([*at, "--build", "--data", str(tmp_path / "none.json")], spark) == 1
    assert cli.main([*at, "--build", "--data", str(tmp_path / "d.json")], spark) == 0
    assert "total_documents: 3" in capsys.readouterr().out
    assert cli.main([*at, "-s"], spark) == 0
    assert cli.main([*at, "-f", str(tmp_path / "q.txt"), "-o", str(tmp_path / "out"), "-l", "1"], spark) == 0
    shown = capsys.readouterr().out
    assert 'Query 1: "coat"\n  Results: 2' in shown and "... and 1 more" in shown
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert "Query: coat\nResults: 2\n  - One (u1)\n  - Untitled Document ()" in text and "Query: none\nResults: 0" in text
    assert cli.main([*at, "coat", "&&", "silk"], spark) == 0
    asked = iter(["", "help", "coat", "quit"])
    assert cli.main([*at, "-i", "-o", str(tmp_path / "log")], spark, lambda _: next(asked)) == 0
    assert "Query: coat\nResults: 2\nTimestamp: " in (tmp_path / "log").read_text()
    assert cli.main([], spark) == 1


def test_streamed_upserts(spark, tmp_path):
    schema = "url string, title string, content string, content_hash string, source string, word_count int, first_crawled timestamp, last_crawled timestamp, update_count int, last_modified timestamp"
    store = VersionedStore(spark, str(tmp_path / "store"))
    pages = "url string, title string, content string, source string, crawled_at timestamp"

    def run(rows):
        spark.createDataFrame(rows, pages).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream_upserts(spark.readStream.schema(pages).parquet(str(tmp_path / "in")), store, spark.createDataFrame([], schema), str(tmp_path / "ck")).awaitTermination()
        return {r.url: (r.content, r.update_count) for r in store.current().collect()}

    assert run([("https://a/x", "t", "one", "s", datetime(2025, 1, 1)), ("https://a/y", "t", "two", "s", datetime(2025, 1, 1))]) == {"https://a/x": ("one", 0), "https://a/y": ("two", 0)}
    assert run([("https://a/x", "t", "other", "s", datetime(2025, 3, 1))]) == {"https://a/x": ("other", 1), "https://a/y": ("two", 0)}


def test_csv_sinks(spark, tmp_path):
    from heddle.operators import corpus
    from heddle.sources.documents import write_stemming_csv, write_token_stats_csv

    docs = spark.createDataFrame([(1, "Red coats, red silk"), (2, None)], "doc_id bigint, content string")
    write_token_stats_csv(corpus.token_stats(docs), str(tmp_path / "t"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "t")).collect()
    assert rows[0].asDict().keys() == {"doc_id", "doc_size_chars", "doc_size_kb", "num_tokens", "avg_token_length", "time_ms"}
    assert {(r.doc_id, r.num_tokens) for r in rows} == {("1", "4"), ("2", "0")}
    table = spark.createDataFrame([("coats", "coat", 2, 3)], "original string, stemmed string, original_count bigint, stemmed_count bigint")
    write_stemming_csv(table, str(tmp_path / "s"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()] == [("coats", "coat", "2", "3")]


def test_index_file_in_several_partitions(spark, tmp_path):
    path = str(tmp_path / "many.bin")
    docs = spark.createDataFrame([(k, f"u{k}", f"Title {k}", f"coat silk term{k} word{k % 3}") for k in range(20)], "doc_id bigint, url string, title string, content string")
    index = build_index(docs)
    indexfile.write(index, path)
    spark.dataSource.register(indexfile.IndexFileSource)
    for section in ("forward", "inverted"):
        whole, cut = (spark.read.format("heddle_index").option("section", section).option("rowsPerPartition", n).load(path) for n in (1 << 16, 3))
        assert cut.rdd.getNumPartitions() > 6 and whole.rdd.getNumPartitions() == 1
        assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
        assert whole.count() == len(indexfile.stretches(path, section, 1))
