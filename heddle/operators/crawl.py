"""Crawl-store operators: upsert of crawled pages, link extraction, frontier search, sources in order."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import text as text_functions
from heddle.functions import url as url_functions
from heddle.session import write_stage

RECHECK_DAYS = 30


def upsert(store: DataFrame, crawled: DataFrame, now: Column, recheck_days: int = RECHECK_DAYS, compare_hash: bool = True) -> DataFrame:
    """The store after a crawl, with ``action`` for each row: kept, skipped, touched, updated or inserted.

    ``store`` has one row per url (url, title, content, content_hash, source, word_count, first_crawled, last_crawled,
    update_count, last_modified); ``crawled`` url, title, content and source. A page crawled less than ``recheck_days``
    times 24 hours ago is skipped; the same md5 only sets last_crawled; other content replaces title, content, hash and
    counts. Without ``compare_hash`` every recrawl replaces. Crawled rows without url or content change nothing. Where
    ``crawled`` has crawled_at, of several rows for one url the newest is taken and its time is the page's ``now``; of
    equally new ones, or without times, the one with the greatest content in byte order.
    """
    timed = "crawled_at" in crawled.columns
    state = F.struct(*["crawled_at"] * timed, "content", "title", "source")
    new = crawled.where("url IS NOT NULL AND content IS NOT NULL AND content <> ''").groupBy("url").agg(F.max(state).alias("n"))
    now = F.coalesce("n.crawled_at", now) if timed else now
    s = F.struct(*store.columns).alias("s")
    both = store.select("url", s).join(new, "url", "full_outer")
    digest = F.md5("n.content")
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("s.last_crawled")) / 86400)
    action = F.when(F.col("s").isNull(), "inserted").when(F.col("n").isNull(), "kept").when(age < recheck_days, "skipped")
    action = action.when(F.lit(compare_hash) & (F.col("s.content_hash") == digest), "touched").otherwise("updated")
    rows = both.withColumn("action", action)
    fresh, written = F.col("action") == "inserted", F.col("action").isin("inserted", "updated")
    title = F.when(F.coalesce(F.col("n.title"), F.lit("")) != "", F.col("n.title"))
    values = {
        "title": F.when(fresh, F.coalesce(title, url_functions.title_from_url(F.col("url")))).when(written, F.coalesce(title, F.col("s.title"), F.lit(""))).otherwise(F.col("s.title")),
        "content": F.when(written, F.col("n.content")).otherwise(F.col("s.content")),
        "content_hash": F.when(written, digest).otherwise(F.col("s.content_hash")),
        "source": F.when(fresh, F.col("n.source")).otherwise(F.col("s.source")),
        "word_count": F.when(written, text_functions.word_count(F.col("n.content"))).otherwise(F.col("s.word_count")),
        "first_crawled": F.when(fresh, now).otherwise(F.col("s.first_crawled")),
        "last_crawled": F.when(F.col("action").isin("inserted", "updated", "touched"), now).otherwise(F.col("s.last_crawled")),
        "update_count": F.when(fresh, F.lit(0)).when(written, F.coalesce(F.col("s.update_count"), F.lit(0)) + 1).otherwise(F.col("s.update_count")),
        "last_modified": F.when(F.col("action") == "updated", now).otherwise(F.col("s.last_modified")),
    }
    others = [F.col(f"s.{c}").alias(c) for c in store.columns if c not in values and c != "url"]
    return rows.select("url", *[v.alias(k) for k, v in values.items()], *others, "action")


class _Anchors(HTMLParser):
    """The href of every <a>, entities decoded, quoted or not."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found += [v.strip() for k, v in attrs if k == "href" and v and v.strip() and not v.strip().startswith("#")]


def _absolute(html: str | None, page: str | None) -> list[str]:
    if not html:
        return []
    parser = _Anchors()
    parser.feed(html)
    parser.close()
    out = []
    for href in parser.found:
        try:
            out.append(urljoin(page or "", href))
        except ValueError:  # no address, like a broken IPv6 host
            continue
    return list(dict.fromkeys(out))


def links(pages: DataFrame, html: Column, base_domain: Column, page_url: Column | None = None) -> DataFrame:
    """``pages`` exploded to distinct (…, link): normalised, valid targets of its <a href>, without those in the page.

    Relative targets are resolved against the page's own address, ``page_url``, or the domain's root where it is not given
    or null. Other columns stay.
    """

    @F.pandas_udf("array<string>")
    def absolute(html: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([_absolute(h, u) for h, u in zip(html, page)])

    root = F.concat(F.lit("https://"), base_domain, F.lit("/"))
    here = root if page_url is None else F.coalesce(page_url, root)
    rows = pages.withColumn("_d", base_domain).withColumn("link", F.explode(absolute(html, here)))
    rows = rows.withColumn("link", url_functions.normalize_url(F.col("link"), F.col("_d")))
    return rows.where(url_functions.is_valid_url(F.col("link"), F.col("_d"))).drop("_d").distinct()


def frontier(edges: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """(url, depth): what can be reached from ``starts`` (url) over ``edges`` (source, target), with the least depth.

    Where ``starts`` has site, each site has a frontier of its own, and the result has site as well. One level at a time: a
    join and an anti-join with what has been visited; each level is written, so a lost executor costs no earlier level.
    """
    key = [c for c in ("site", "url") if c in starts.columns]
    level = starts.where("url IS NOT NULL").select(*key).distinct().withColumn("depth", F.lit(0))
    seen = write_stage(level, "level-0")
    visited, last = seen, seen
    for depth in range(1, max_depth + 1):
        reached = last.join(edges, last["url"] == edges["source"]).select(*[last[c] for c in key if c != "url"], F.col("target").alias("url")).distinct()
        nxt = reached.join(visited, key, "left_anti").withColumn("depth", F.lit(depth))
        last = write_stage(nxt, f"level-{depth}")
        if last.isEmpty():
            break
        visited = visited.unionByName(last)
    return visited


def capped(found: DataFrame, most: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The first ``most`` rows in the given order, of each group of ``by`` (a site) or altogether.

    The cap is the feature: a crawl takes so many articles and no more. Within groups each task keeps its own first rows
    before the shuffle, so that one large site doesn't go to one task.
    """
    if not by:
        return found.orderBy(*order).limit(most)
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def crawl_sites(sources: DataFrame, edges: DataFrame, max_depth: int = 3, most_articles: int = 1000) -> DataFrame:
    """(place, name, url, depth): the articles of all sites, at most ``most_articles`` of each, nearest first.

    ``sources`` has name, base_url, start_urls, article_patterns and priority. Every site starts from its start_urls (or
    base_url where it has none) and follows ``edges``; articles on its domain are taken, and ``place`` is the sites'
    order of priority. Sites do not wait for each other: all are searched level by level at once.
    """
    begin = F.when(F.size(F.coalesce("start_urls", F.array().cast("array<string>"))) > 0, F.col("start_urls")).otherwise(F.array("base_url"))
    starts = sources.select(F.col("name").alias("site"), F.explode(begin).alias("url"))
    config = sources.select(F.col("name").alias("site"), url_functions.domain(F.col("base_url")).alias("_base"), "article_patterns", F.coalesce("priority", F.lit(3)).alias("_p"))
    reached = frontier(edges, starts, max_depth).join(config, "site")
    good = url_functions.is_valid_url(F.col("url"), F.col("_base")) & url_functions.is_article_url(F.col("url"), F.col("article_patterns"))
    taken = capped(reached.where(good), most_articles, [F.col("depth"), F.col("url")], ["site"])
    order = config.select("site", F.row_number().over(Window.orderBy("_p", "site")).alias("place"))  # one row per configured site
    return taken.join(order, "site").select("place", F.col("site").alias("name"), "url", "depth")


def wiki_pages(pages: DataFrame, least_words: int = 200, least_keywords: int = 3) -> DataFrame:
    """(url, title, content, source, pageid) of an encyclopedia's articles that are long enough and on topic; the address is
    made from the title. For ``upsert`` with ``compare_hash=False``: a recheck always replaces.

    ``pages`` has title, content and pageid; rows without title or content have no page.
    """
    rows = pages.where("title IS NOT NULL AND content IS NOT NULL").select(F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace("title", F.lit(" "), F.lit("_"))).alias("url"), "title", "content", F.lit("Wikipedia").alias("source"), "pageid")
    return rows.where((text_functions.word_count(F.col("content")) >= least_words) & (text_functions.keyword_hits(F.col("content")) >= least_keywords))


def write_store(store: DataFrame, path: str) -> None:
    """Writes a crawl store with one row per url, its newest, in folders by source and sorted by url: a lookup by source
    prunes folders, one by url row groups. Rows without url are left out."""
    rest = [c for c in store.columns if c not in ("url", "last_crawled", "content_hash")]
    newest = store.where("url IS NOT NULL").groupBy("url").agg(F.max(F.struct("last_crawled", "content_hash", *rest)).alias("s"))
    newest.select("url", "s.*").repartitionByRange("source", "url").sortWithinPartitions("source", "url").write.mode("overwrite").partitionBy("source").parquet(path)


def categories(members: DataFrame, roots: list[str], max_depth: int = 3) -> DataFrame:
    """(pageid): articles below the root categories, once each.

    ``members`` has category, title, pageid and is_category; subcategories with "disambiguation" in the title are not
    entered. A category that is reached at several depths is entered at the least, which reaches all that the others do.
    """
    spark = members.sparkSession
    sub = members.where("is_category AND NOT contains(lower(title), 'disambiguation')").select(F.col("category").alias("source"), F.col("title").alias("target"))
    reached = frontier(sub, spark.createDataFrame([(r,) for r in roots], "url string"), max_depth)
    return members.where("NOT is_category").join(reached, members["category"] == reached["url"], "left_semi").select("pageid").distinct()


def by_priority(sources: DataFrame) -> DataFrame:
    """Source configurations in order of priority, 3 where missing, then of name."""
    return sources.orderBy(F.coalesce("priority", F.lit(3)), "name")


_DROPPED = {"script", "style", "iframe", "nav", "footer", "aside", "header", "form", "button"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Node:
    __slots__ = ("tag", "attrs", "parts", "parent")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [p for p in reversed(node.parts) if isinstance(p, _Node)]

    def texts(self, dropped: bool):
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if x.strip():
                    yield x.strip()
            elif not (dropped and x.tag in _DROPPED):
                stack += reversed(x.parts)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.parts.append(node)
        if tag not in _VOID:
            self.now = node

    def handle_endtag(self, tag):
        node = self.now
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.now = node.parent

    def handle_data(self, data):
        self.now.parts.append(data)


def _classes(node: _Node) -> list[str]:
    return node.attrs.get("class", "").split()


# Where a page's content stands, in order of trust.
_CONTENT = (
    lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main",
    *[lambda n, c=c: c in _classes(n) for c in ("article-content", "post-content", "entry-content", "article-body", "story-body", "content-body")],
    *[lambda n, c=c: c in n.attrs.get("class", "") for c in ("article", "content", "post", "story")],
)


def read_article(html: str | None) -> tuple[str | None, str | None]:
    """Title and content of a page: the first heading or title over ten characters, and the largest element of the first
    kind of container with 100 words; else the paragraphs over ten words, at most twenty."""
    if not html:
        return None, None
    tree = _Tree()
    tree.feed(html)
    tree.close()
    nodes = list(tree.root.walk())
    title = None
    heads = [next((n for n in nodes if n.tag == "h1"), None), next((n for n in nodes if n.tag == "title"), None)]
    found = ["".join(n.texts(False)) for n in heads if n is not None]
    metas = [n.attrs.get("content", "") for key, name in (("property", "og:title"), ("name", "twitter:title")) for n in [next((m for m in nodes if m.tag == "meta" and m.attrs.get(key) == name), None)] if n is not None]
    for title in [*found, *metas]:
        if len(title) > 10:
            break
    dropped = {id(x) for n in nodes if n.tag in _DROPPED for x in n.walk()}
    left = [n for n in nodes if id(n) not in dropped]
    content = ""
    for picks in _CONTENT:
        chosen = [n for n in left if n.tag and picks(n)]
        if chosen:
            content = " ".join(" ".join(max(chosen, key=lambda n: sum(map(len, n.texts(True)))).texts(True)).split())
            if len(content.split()) >= 100:
                break
    if len(content.split()) < 100:
        paragraphs = ["".join(n.texts(True)) for n in left if n.tag == "p"]
        long = [p for p in paragraphs if len(p.split()) > 10]
        if long:
            content = " ".join(" ".join(long[:20]).split())
    return title, content or None


def articles(pages: DataFrame, html: str = "html", least_words: int = 200, least_keywords: int = 3) -> DataFrame:
    """``pages`` with title and content read from the html; pages with fewer words or topic keywords are left out."""

    @F.pandas_udf("title string, content string")
    def read(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_article(x) for x in column], columns=["title", "content"])

    rows = pages.withColumn("_a", read(F.col(html))).withColumn("title", F.col("_a.title")).withColumn("content", F.col("_a.content")).drop("_a")
    return rows.where((text_functions.word_count(F.col("content")) >= least_words) & (text_functions.keyword_hits(F.col("content")) >= least_keywords))
