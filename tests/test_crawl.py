from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heddle.functions import url
from heddle.operators import crawl, ledger

NOW = datetime(2025, 6, 1)


def test_urls(spark):
    rows = ["HTTPS://Www.A.example/x/y///?q=1#f", "http://a.example", "/p/q;v=1", "mailto:x@y"]
    df = spark.createDataFrame([(r,) for r in rows], "u string")
    assert [r[0] for r in df.select(url.normalize_url(F.col("u"), F.lit("b.example"))).limit(3).collect()] == ["https://Www.A.example/x/y", "http://a.example", "https://b.example/p/q"]
    valid = [("https://www.a.example/x", True), ("https://z.example/x", False), ("https://a.example/x.JPG", False), ("ftp://a.example/x", False), ("mailto:x", True)]
    got = spark.createDataFrame(valid, "u string, v boolean").select("v", url.is_valid_url(F.col("u"), F.lit("a.example"))).collect()
    assert all(a == b for a, b in got)
    titles = spark.createDataFrame([("https://a.example/x/red-silk_coat/",), ("https://a.example/one",)], "u string").select(url.title_from_url(F.col("u"))).collect()
    assert [r[0] for r in titles] == ["Red Silk Coat", "Статья с a.example"]


def test_upsert(spark):
    old = lambda u, text, days: (u, "t", text, None, "s", 1, NOW, NOW - timedelta(days=days), 1, None)
    store = spark.createDataFrame([old("https://a/kept", "x", 90), old("https://a/skip", "x", 3), old("https://a/same", "x", 40), old("https://a/new text", "x", 40)], "url string, title string, content string, content_hash string, source string, word_count int, first_crawled timestamp, last_crawled timestamp, update_count int, last_modified timestamp")
    store = store.withColumn("content_hash", F.md5("content"))
    crawled = spark.createDataFrame([("https://a/skip", "n", "y", "s"), ("https://a/same", "n", "x", "s"), ("https://a/new text", None, "y z", "s"), ("https://a/red-coat", "", "y", "s"), ("https://a/red-coat", "", "y", "s"), (None, "n", "y", "s"), ("https://a/none", "n", None, "s")], "url string, title string, content string, source string")
    out = {r.url.rsplit("/", 1)[1]: r for r in crawl.upsert(store, crawled, F.lit(NOW)).collect()}
    assert {k: r.action for k, r in out.items()} == {"kept": "kept", "skip": "skipped", "same": "touched", "new text": "updated", "red-coat": "inserted"}
    assert (out["new text"].update_count, out["new text"].word_count, out["new text"].title, out["new text"].last_modified) == (2, 2, "t", NOW)
    assert (out["red-coat"].title, out["red-coat"].update_count, out["same"].last_crawled) == ("Red Coat", 0, NOW)
    again = {r.action for r in crawl.upsert(store, crawled, F.lit(NOW), compare_hash=False).collect()}
    assert "touched" not in again


def test_links_and_frontier(spark):
    html = """<a href="/one">1</a><A class=x HREF='https://a.example/two/?q=1'>2</a><a href="#top">t</a><a href="">e</a><a href="https://z.example/x">z</a><a href="/p.png">p</a><a href="/one/">1</a>"""
    pages = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    got = crawl.links(pages, F.col("html"), F.lit("a.example")).select("link").collect()
    assert sorted(r[0] for r in got) == ["https://a.example/one", "https://a.example/two"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("a", "c")], "source string, target string")
    reached = crawl.frontier(edges, spark.createDataFrame([("a",), ("a",), (None,)], "url string"), 2).collect()
    assert sorted(map(tuple, reached)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    members = spark.createDataFrame([("R", "S", None, True), ("R", "X (disambiguation)", None, True), ("S", "p", 1, False), ("R", "p", 1, False), ("X (disambiguation)", "q", 2, False)], "category string, title string, pageid bigint, is_category boolean")
    assert [r[0] for r in crawl.categories(members, ["R"]).collect()] == [1]


def test_article_reader(spark):
    body = "silk dress by a designer " * 60
    page = f"<html><head><title>Short</title></head><body><nav>menu menu</nav><h1>A heading long enough</h1><article><p>{body}</p><script>x()</script><footer>foot</footer></article></body>"
    title, content = crawl.read_article(page)
    assert title == "A heading long enough" and content.split() == body.split()
    assert crawl.read_article(None) == (None, None)
    paragraphs = "<p>" + "one two three four five six seven eight nine ten eleven</p><p>short</p>"
    assert crawl.read_article(paragraphs)[1].endswith("eleven")
    rows = spark.createDataFrame([(1, page), (2, "<p>no</p>"), (3, None)], "id int, html string")
    assert [r.id for r in crawl.articles(rows).collect()] == [1]


STORE = "url string, rec_id bigint, last_crawled timestamp, content_hash string, content string, extra string"


def _state(u, rec, day, digest, content="c"):
    return (u, rec, None if day is None else datetime(2025, 1, day), digest, content, "x")


def test_page_states(spark):
    store = spark.createDataFrame(
        [
            _state("https://A.example/p/?q=1", 1, 1, "old"), _state("https://a.example/p", 2, 3, " NEW "), _state("https://a.example/p#x", 3, 2, "mid"),
            _state("https://a.example/q", 4, 1, "", "text"), _state("https://a.example/q", 4, 1, "", "text"),
            _state("https://a.example/r", 5, None, "r"), _state("https://a.example/s", 6, 1, None, None), _state(None, 7, 1, "n"),
            _state("https://a.example/t", 8, 1, "t1"), _state("https://a.example/t", 9, 1, "t2"),
        ],
        STORE,
    )
    md5 = "1cb251ec0d568de6a929b520c4aed8d1"
    done = spark.createDataFrame([(1, "https://a.example/p", "old"), (3, "https://a.example/p/", "NEW"), (9, "https://a.example/p", "old"), (1, "https://a.example/q", md5.upper()), (1, "https://a.example/q", md5)], "run_id int, url string, content_hash string")
    runs = spark.createDataFrame([(1, "success"), (3, "success"), (9, "failed")], "run_id int, status string")
    got = {r.rec_id: r.state for r in ledger.page_states(store, done, runs).collect()}
    assert got == {2: "done", 4: "done", 5: "pending", 6: "pending", 9: "pending"}
    empty = ledger.page_states(store.limit(0), done.limit(0), runs.limit(0))
    assert empty.count() == 0


def test_ledger_survives_failures(spark, tmp_path):
    book = ledger.WorkLedger(spark, str(tmp_path / "ledger"))
    items = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "item string, version string")
    at = lambda minute: F.lit(datetime(2025, 1, 1, 0, minute))
    states = lambda minute, x=items: {r.item: r.state for r in book.states(x, at(minute)).collect()}
    assert set(states(0).values()) == {"pending"}
    first, rows = book.lease(items, "w1", 600, limit=2, now=at(0))
    assert sorted(r.item for r in rows.collect()) == ["a", "b"]
    assert states(1) == {"a": "leased", "b": "leased", "c": "pending"}
    second, rows = book.lease(items, "w2", 600, now=at(1))
    assert [r.item for r in rows.collect()] == ["c"] and second > first
    book.commit(second)
    book.commit(second)  # a repeated commit changes nothing
    assert states(2)["c"] == "done"
    # the first worker is lost; its lease expires and another takes over
    assert states(20) == {"a": "pending", "b": "pending", "c": "done"}
    third, rows = book.lease(items, "w3", 600, now=at(20))
    assert sorted(r.item for r in rows.collect()) == ["a", "b"]
    with pytest.raises(ledger.StaleToken):
        book.commit(first)
    book.commit(third)
    assert set(states(21).values()) == {"done"}
    assert book.done().count() == 3
    # folding tokens changes no state
    assert book.compact(at(21)) == 3 and book.compact(at(21)) == 0
    assert set(states(21).values()) == {"done"} and book.done().count() == 3
    with pytest.raises(ledger.StaleToken):
        book.commit(first)
    # a changed record is pending again
    changed = spark.createDataFrame([("a", "2"), ("b", "1")], "item string, version string")
    assert states(22, changed) == {"a": "pending", "b": "done"}
    # a lease of the new version is lost, and the record goes back to what was committed
    fourth, _ = book.lease(changed, "w4", 60, now=at(22))
    assert fourth > third and states(22, changed)["a"] == "leased" and states(30, changed)["a"] == "pending"
    assert states(30) == {"a": "done", "b": "done", "c": "done"}
    book.compact(at(30))
    assert states(30) == {"a": "done", "b": "done", "c": "done"} and states(31, changed)["a"] == "pending"
    fifth, _ = book.lease(changed, "w5", 60, now=at(31))
    book.commit(fifth)
    assert states(32, changed) == {"a": "done", "b": "done"} and states(32)["a"] == "pending"


def test_recorded_runs_are_taken_in_once(spark, tmp_path):
    store = spark.createDataFrame([(1, "https://h/a", NOW, "X", "x"), (2, "https://h/b", NOW, "y", "y"), (3, None, NOW, "y", "y")], "rec_id bigint, url string, last_crawled timestamp, content_hash string, content string")
    done = spark.createDataFrame([(1, "https://h/a/", "x"), (2, "https://h/a", "z"), (3, "https://h/b", "Y"), (None, "https://h/b", "q"), (9, "https://h/b", "q")], "run_id int, url string, content_hash string")
    runs = spark.createDataFrame([(1, NOW, NOW, "success"), (2, NOW, None, "aborted"), (3, NOW, NOW, "success")], "run_id int, started_at timestamp, finished_at timestamp, status string")
    path = str(tmp_path / "ledger")
    for _ in range(2):
        got = {r.rec_id: r.state for r in ledger.page_states(store, done, runs, path).collect()}
        assert got == {1: "done", 2: "done"}
    book = ledger.WorkLedger(spark, path)
    assert book.leases().count() == 4 and book.done().count() == 2
    token, rows = book.lease(ledger.newest_states(store.withColumn("content_hash", F.lit("new"))), "next", 60)
    assert token > 9 and rows.count() == 2


def test_links_of_a_page(spark):
    html = '<a href="../next.html">a</a><a href=bare.html>b</a><A HREF="/x?a=1&amp;b=2">c</A><a href="?q=1">d</a><a href="http://[broken">e</a><a>f</a>'
    pages = spark.createDataFrame([(1, "https://a.example/s/t/page.html", html, "clash"), (2, None, html, None)], "id int, url string, html string, link0 string")
    got = {(r.id, r.link) for r in crawl.links(pages, F.col("html"), F.lit("a.example"), F.col("url")).collect()}
    root = "https://a.example"
    assert got == {(1, f"{root}/s/next.html"), (1, f"{root}/s/t/bare.html"), (1, f"{root}/x"), (1, f"{root}/s/t/page.html"), (2, f"{root}/next.html"), (2, f"{root}/bare.html"), (2, f"{root}/x"), (2, root)}


def test_upsert_takes_the_newest_state(spark):
    columns = "url string, title string, content string, source string, crawled_at timestamp"
    crawled = spark.createDataFrame([("https://a/p", "t", "zzz older", "s", datetime(2025, 1, 1)), ("https://a/p", "t", "aaa newer", "s", datetime(2025, 1, 5)), ("https://a/q", "t", "x", "s", None)], columns)
    store = spark.createDataFrame([], "url string, title string, content string, content_hash string, source string, word_count int, first_crawled timestamp, last_crawled timestamp, update_count int, last_modified timestamp")
    out = {r.url: r for r in crawl.upsert(store, crawled, F.lit(NOW)).collect()}
    assert (out["https://a/p"].content, out["https://a/p"].last_crawled) == ("aaa newer", datetime(2025, 1, 5))
    assert out["https://a/q"].last_crawled == NOW


def test_all_sites_with_caps(spark):
    sites = spark.createDataFrame([("B", "https://b.example", None, ["/look/"], 1), ("A", "https://a.example", ["https://a.example/start"], None, None)], "name string, base_url string, start_urls array<string>, article_patterns array<string>, priority int")
    edges = [("https://a.example/start", f"https://a.example/news/{k}") for k in range(9)] + [("https://b.example", "https://b.example/look/1"), ("https://b.example/look/1", "https://b.example/look/2"), ("https://b.example", "https://a.example/news/1"), ("https://b.example", "https://b.example/about")]
    edges = spark.createDataFrame(edges, "source string, target string")
    got = [(r.place, r.name, r.url.rsplit("/", 1)[1], r.depth) for r in crawl.crawl_sites(sites, edges, most_articles=4).orderBy("place", "depth", "url").collect()]
    assert got == [(1, "B", "1", 1), (1, "B", "2", 2), *[(2, "A", str(k), 1) for k in range(4)]]
    assert crawl.crawl_sites(sites.limit(0), edges).count() == 0
    assert crawl.capped(edges, 3, [F.col("target")]).count() == 3


def test_wiki_pages(spark):
    body = "silk dress designer textile " * 60
    rows = spark.createDataFrame([("Red silk", body, 1), ("Short", "silk dress designer", 2), ("Off topic", "word " * 300, 3), (None, body, 4), ("None", None, 5)], "title string, content string, pageid bigint")
    assert [(r.url, r.source, r.pageid) for r in crawl.wiki_pages(rows).collect()] == [("https://en.wikipedia.org/wiki/Red_silk", "Wikipedia", 1)]


def test_written_store(spark, tmp_path):
    rows = [("u1", 1, "old", "s"), ("u1", 3, "new", "s"), ("u2", 1, "x", None), (None, 1, "y", "s"), ("u1", 3, "new", "s")]
    store = spark.createDataFrame([(u, datetime(2025, 1, d), h, s, d) for u, d, h, s in rows], "url string, last_crawled timestamp, content_hash string, source string, extra int")
    crawl.write_store(store, str(tmp_path / "store"))
    got = {(r.url, r.content_hash, r.source, r.extra) for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert got == {("u1", "new", "s", 3), ("u2", "x", None, 1)}
