"""URL functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def page_key(url: Column) -> Column:
    """The page of a url: query string, fragment and trailing slashes cut off, scheme and host lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#][\s\S]*$", ""), "/+$", "")
    origin = F.regexp_extract(bare, _ORIGIN, 1)
    return F.concat(F.lower(origin), F.substr(bare, F.length(origin) + 1))


def normalize_url(url: Column, base_domain: Column | None = None) -> Column:
    """A url without parameters of the last segment, query, fragment and trailing slashes; scheme in lower case, host as it is.

    A url without host is taken as a path of ``base_domain``.
    """
    if base_domain is not None:
        here = F.concat(F.lit("https://"), base_domain)
        relative = ~url.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
        url = F.when(relative, F.concat(here, F.when(url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url)))).otherwise(url)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*[^?#;]*)", 1)
    path = F.regexp_replace(rest, r"^([^/]*)((?:.*[^/])?)/*$", "$1$2")
    return F.concat(scheme, F.lit("://"), path)


def domain(url: Column) -> Column:
    """The host part; empty where there is none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


# Endings of files that are no pages, and address parts of articles.
ASSET_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".pdf", ".zip", ".mp4", ".mp3", ".css", ".js")
ARTICLE_PARTS = (
    "/article/", "/story/", "/news/", "/blog/", "/post/",
    "/fashion/", "/style/", "/trends/", "/collection/",
    "/runway/", "/designer/", "/couture/", "/lookbook/",
)


def is_valid_url(url: Column, base_domain: Column) -> Column:
    """Whether a url may be crawled: on the domain, over http, no asset. A url without host passes."""
    host = domain(url)
    path = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#;]*)", 1))
    asset = F.lit(False)
    for ending in ASSET_ENDINGS:
        asset = asset | path.endswith(ending)
    return (host == "") | (F.contains(host, base_domain) & ~asset & F.lower(url).rlike("^https?://"))


def is_article_url(url: Column, patterns: Column) -> Column:
    """Whether the lower-cased url holds one of the source's patterns or of the usual parts of article addresses."""
    low = F.lower(url)
    usual = F.lit(False)
    for part in ARTICLE_PARTS:
        usual = usual | F.contains(low, F.lit(part))
    return usual | F.coalesce(F.exists(patterns, lambda p: F.contains(low, p)), F.lit(False))


def title_from_url(url: Column) -> Column:
    """A title from the last part of the path, if it has more than one word; else a notice with the domain."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)", 1), "^/+|/+$", "")
    words = F.translate(F.element_at(F.split(path, "/"), -1), "-_", "  ")
    many = F.size(F.filter(F.split(words, r"\s+"), lambda w: w != "")) > 1
    return F.when(many, F.initcap(words)).otherwise(F.concat(F.lit("Статья с "), domain(url)))
