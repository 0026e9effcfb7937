"""Main body of crawled pages: substrings that a host repeats on distinct pages are cut, unique runs are kept.

A page's text is a stream of tokens, parsed into phrases at places that only the text around them decides: line ends,
separators of items, lead-ins before a colon, sentence ends, and in long stretches without any of these after pairs of
words whose hash says so. The suffixes of all streams of a host are sorted (``suffixes``), which tells for every phrase
how long a string from here on is repeated on at least ``least_pages`` distinct pages; longer strings are chains.
What the repeated strings cover decides:

* a line is page furniture if repeated strings cover it whole; if they cover at least half of its items (navigation in one
  line) or its lead-in; or if those of at least ``LONG`` words leave but a few words of it;
* a sentence of at most three words, which an article may hold as well, only if it stands on half of the host's pages, or
  if it is part of a longer repeated run: on nearly all of its pages next to the same line;
* a line under a heading over links - a repeated line that is followed by something new nearly everywhere - is a link if it
  looks like one: a headline without sentence end, with a number in front, or followed by a colon and a teaser;
* what stands before the page's headline (the line that the title or the url's last part spells) is none of the body.

Everything else is main body. Of its lines the strings of at least ``LONG`` words that are repeated within them are cut
(``main_body``), whatever the share of the host's pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.suffixes import repeated_prefixes
from heddle.session import spread, write_stage

#: Share of a repeated line's places at which a new headline-like unit follows, from which it is a heading over links.
HEADING_SHARE = 0.6
#: Share of a host's pages from which a sentence of at most three words is furniture wherever it stands, and share of
#: the sentence's own pages from which the same line next to it makes a repeated run with it.
SHORT_SHARE, RUN_SHARE = 0.5, 0.8
#: Words of a repeated string from which it is cut out of a line with other text; the greatest number and share of a
#: line's words outside such strings with which the whole line is furniture.
LONG, REST, REST_SHARE = 20, 8, 0.2
#: A phrase of more words is cut on by the hashes of its words, after one pair of neighbours in ``TRIGGER``.
LONG_PHRASE, TRIGGER = 24, 8

_HEADLINE, _SENTENCE, _SHORT, _TEASER, _LEAD, _ITEMS = 1, 2, 4, 8, 16, 32
_DIGITS = re.compile(r"\d+")
_NO_WORD = re.compile(r"[^\w\n\x01\x02\x03]+")
_ONE_WORD = re.compile(r"[^\W_]+")
_CONTROL = re.compile(r"[\x01\x02\x03]")
_AFTER_SENTENCE = re.compile(r"[.!?…](?:(?<=[^\W\d_]{2}.)|(?<=\d{4}.)|(?<=[\"”»’')\]%].))[\"”»’')\]]*[^\S\n]+(?=\S)")
_SEPARATOR = re.compile(r"[|›/·•»>]|[^\S\n]{2,}")
_LEAD_IN = re.compile(r"^([^\S\n]*[^:\n]{2,40}):(?=[^\S\n]+\S)", re.M)
_END = re.compile(r"[.!?…][\"”»’')\]]*\s*$")
_NUMBERED = re.compile(r"\s*\d{1,3}[.)]\s")
_HEAD_COLON = re.compile(r"\s*[^:.!?]{5,80}: \S")
_HOST = re.compile(r"\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)")
_LISTS = ("line_no", "flags", "n_phrases", "symbols", "sizes")
_PAGE = "rec_id bigint, place bigint, host bigint, page bigint, line_no array<int>, flags array<int>, n_phrases array<int>, symbols array<bigint>, sizes array<int>"
_PAGE_ARROW = pa.schema([(c, pa.int64()) for c in ("rec_id", "place", "host", "page")] + [(c, pa.list_(pa.int64() if c == "symbols" else pa.int32())) for c in _LISTS])


def _words(text: str) -> str:
    low = text.lower()
    return _NO_WORD.sub(" ", _DIGITS.sub("0", low.replace("_", " ") if "_" in low else low))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _triggered(phrase: str) -> list[str]:
    """A long phrase cut after pairs of words by their hash, alike wherever the same words stand."""
    words = phrase.split(" ")
    out, begin = [], 0
    for k in range(1, len(words)):
        if xxhash.xxh3_64_intdigest(f"{words[k - 1]} {words[k]}") % TRIGGER == 0:
            out.append(" ".join(words[begin : k + 1]))
            begin = k + 1
    if begin < len(words):
        out.append(" ".join(words[begin:]))
    return out


def read_page(url: str | None, title: str | None, content: str | None) -> tuple[int, int, list[int], list[int], list[int], list[int], list[int]]:
    """Fingerprints of host and page, and of its non-blank lines: number, flags, number of phrases; the phrases' symbols
    and numbers of words. Each run of digits is one 0; a line without letters or digits is one phrase."""
    m = _HOST.match(url or "")
    host, path = (m[1] or "").lower(), m[2].rstrip("/\n ")
    salt = xxhash.xxh3_64_intdigest(host)
    slug = _words(path.rsplit("/", 1)[-1].replace("-", " ")).strip()
    names = {_words(title).strip()} if title else set()
    numbers, flags, n_phrases, symbols, sizes = [], [], [], [], []
    text = _CONTROL.sub(" ", content or "")
    parsed = _AFTER_SENTENCE.sub("\x01", text)
    if ":" in parsed:
        parsed = _LEAD_IN.sub("\\1\x03", parsed)
    parsed = _SEPARATOR.sub("\x02", parsed)
    for number, (line, raw) in enumerate(zip(text.split("\n"), _words(parsed).split("\n")), 1):
        words = raw.strip(" \x01\x02\x03")
        if not words:
            if not line or line.isspace():
                continue
            words = line.strip()  # symbols only
        flag = 0
        if "\x01" in words or "\x02" in words or "\x03" in words:
            if "\x03" in words:
                flag |= _LEAD
            if "\x02" in words:
                flag |= _ITEMS
            phrases = [p for p in (x.strip() for x in words.replace("\x02", "\x01").replace("\x03", ":\x01").split("\x01")) if p]
            whole = " ".join(phrases).replace(":", "")
        else:
            phrases, whole = [words], words
        if whole in names or _spells(slug, whole):
            flag |= _HEADLINE
        end = _END.search(line)
        if end:
            flag |= _SENTENCE
        if whole.count(" ") < 3:
            flag |= _SHORT
        if not end or _NUMBERED.match(line) or _HEAD_COLON.match(line):
            flag |= _TEASER
        if len(whole) > 4 * LONG_PHRASE and any(p.count(" ") >= LONG_PHRASE for p in phrases):
            phrases = [y for p in phrases for y in (_triggered(p) if p.count(" ") >= LONG_PHRASE else [p])]
        numbers.append(number)
        flags.append(flag)
        n_phrases.append(len(phrases))
        for p in phrases:
            symbols.append(_signed(xxhash.xxh3_64_intdigest(p, salt)))
            sizes.append(p.count(" ") + 1)
    return _signed(salt), _signed(xxhash.xxh3_64_intdigest(path, salt)), numbers, flags, n_phrases, symbols, sizes


def _spells(slug: str, words: str) -> bool:
    """Whether a url's last part is these words, cut off after 45 letters or followed by a short id. A url has gaps for
    other letters than a-z."""
    if not words.isascii():
        words = re.sub(r"[^a-z0]+", " ", words).strip()
    return len(words) >= 4 and slug.startswith(words[:45]) and (len(words) >= 45 or len(slug) - len(words) <= 8)


def _place(rec_id: int, content: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(content, rec_id & ((1 << 64) - 1)))


def _read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            ids, *texts = (batch.column(k).slice(at, 1000).to_pylist() for k in range(4))
            rows = [(i, _place(i, x[2]), *read_page(*x)) for i, x in zip(ids, zip(*texts))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(_PAGE_ARROW)], schema=_PAGE_ARROW)


_WHOLE, _PART = 1, 2


class _Lines:
    """The lines of a batch of pages as arrays over all of them."""

    def __init__(self, batch: pa.RecordBatch, marks: str | None = None):
        lists = {c: batch.column(c) for c in _LISTS}
        flat = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
        size = lambda c: lists[c].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.pages, lines, phrases = batch.num_rows, size("line_no"), size("symbols")
        self.number, self.flag, self.n = flat["line_no"], flat["flags"], flat["n_phrases"].astype(np.int64)
        self.symbol, self.size = flat["symbols"], flat["sizes"].astype(np.int64)
        self.page = np.repeat(np.arange(self.pages), lines)  # of each line
        self.start = np.append(0, np.cumsum(self.n))  # of each line among the phrases
        self.line = np.repeat(np.arange(len(self.n)), self.n)  # of each phrase
        self.first_line, self.first_phrase = np.append(0, np.cumsum(lines)), np.append(0, np.cumsum(phrases))
        self.short = ((self.flag & _SHORT) != 0) & ((self.flag & _SENTENCE) != 0)
        # a line's own symbol: that of its phrases in their order
        place = np.arange(len(self.line)) - self.start[:-1][self.line]
        turned = (self.symbol.view(np.uint64) ^ place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        self.unit = np.add.reduceat(turned, self.start[:-1]).view(np.int64) & ~1 if len(self.n) else np.zeros(0, np.int64)
        if marks is not None:
            self.judge(batch.column(marks))

    def per_line(self, values: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values))
        return total[self.start[1:]] - total[self.start[:-1]]

    def judge(self, marks: pa.Array) -> None:
        """What the repeated strings cover. A mark is a phrase's place times four plus the depth of its repeated prefix; depth
        0 marks a short sentence that counts."""
        depth, counts = np.zeros(len(self.symbol), np.int64), np.zeros(len(self.n), bool)
        code = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = self.first_phrase[np.repeat(np.arange(self.pages), n)] + (code >> 2)
        np.maximum.at(depth, at, code & 3)
        counts[self.line[at[code & 3 == 0]]] = True
        once, items = depth >= 1, (self.flag & _ITEMS) != 0
        last = np.zeros(len(depth), bool)
        last[self.start[1:] - 1] = True
        goes_on = once & (last | (depth >= 2))  # repeated together with the line's next phrase, if there is one
        lead = (self.flag & _LEAD) != 0
        known, parts = self.per_line(once), self.n - lead
        lead_known = lead & once[self.start[:-1]]
        whole = np.where(items, known == self.n, self.per_line(goes_on) == self.n) & (~self.short | counts)
        part = lead_known | items & (parts > 1) & (2 * (known - lead_known) >= parts)
        # strings within a line: chains of phrases that go on, in words
        reach = depth >= 2
        link = np.append(False, (reach & ~last)[:-1])  # of each phrase: it follows in a repeated string
        in_string = once & (link | reach & ~last | (self.size >= LONG))
        begins = in_string & ~np.append(False, in_string[:-1] & (link[1:] & in_string[1:])) if len(in_string) else in_string
        string = np.cumsum(begins) - 1
        words = np.bincount(string[in_string], weights=self.size[in_string], minlength=int(begins.sum())).astype(np.int64)
        self.cut = in_string.copy()
        self.cut[in_string] = words[string[in_string]] >= LONG
        total, left = self.per_line(self.size), self.per_line(self.size * ~self.cut)
        most = (left <= REST) & (left <= REST_SHARE * total)
        self.repeated = np.where(whole | most & ~self.short, _WHOLE, np.where(part & ~self.short, _PART, 0))

    def followers(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of lines that are repeated and not the last of their page, and whether something new follows that looks like a headline."""
        at = np.flatnonzero(self.repeated[:-1].astype(bool) & (self.page[:-1] == self.page[1:])) if len(self.page) else np.zeros(0, np.int64)
        new = (self.repeated[at + 1] == 0) & ((self.flag[at + 1] & _HEADLINE) == 0) & ((self.flag[at + 1] & _TEASER) != 0)
        return at, new


def _short_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, place, at, short, beside): short sentences with 0 and with the lines before and after them."""
    for batch in batches:
        x = _Lines(batch)
        k = np.flatnonzero(x.short)
        before, after = k[(k > 0) & (x.page[np.maximum(k - 1, 0)] == x.page[k])], k[(k + 1 < len(x.page)) & (x.page[np.minimum(k + 1, len(x.page) - 1)] == x.page[k])]
        line = np.concatenate([k, before, after])
        beside = np.concatenate([np.zeros(len(k), np.int64), x.unit[before - 1], x.unit[after + 1] | 1])
        host, page, place = (batch.column(c).to_numpy()[x.page[line]] for c in ("host", "page", "place"))
        at = x.start[line] - x.first_phrase[x.page[line]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (host, page, place, at.astype(np.int32), x.unit[line], beside)], names=["host", "page", "place", "at", "short", "beside"])


def _short_marks(pages: DataFrame, least_pages: int) -> DataFrame:
    """(place, mark): short sentences on ``SHORT_SHARE`` of their host's pages, or next to the same line on ``RUN_SHARE`` of theirs."""
    runs = pages.mapInArrow(_short_runs, "host bigint, page bigint, place bigint, at int, short bigint, beside bigint")
    near = runs.select("host", "page", "short", "beside").distinct().groupBy("host", "short", "beside").agg(F.count("*").alias("n"))
    own, beside = (F.max(F.when(c, F.col("n"))) for c in (F.col("beside") == 0, F.col("beside") != 0))
    short = near.groupBy("host", "short").agg(own.alias("n"), F.coalesce(beside, F.lit(0)).alias("together")).where(F.col("n") >= least_pages)
    hosts = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    on_many = F.col("n") >= SHORT_SHARE * F.col("pages")
    in_run = (F.col("together") >= least_pages) & (F.col("together") >= RUN_SHARE * F.col("n"))
    good = short.join(hosts, "host").where(on_many | in_run).select("host", "short")
    return runs.where("beside = 0").join(good, ["host", "short"], "left_semi").select("place", F.col("at") * 4)


def _followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, n, new): how often a repeated line is followed, and by something new that looks like a headline."""
    for batch in batches:
        x = _Lines(batch, "marks")
        at, new = x.followers()
        unit, where = np.unique(x.unit[at], return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(np.bincount(where, minlength=len(unit)).astype(np.int64)), pa.array(np.bincount(where, weights=new, minlength=len(unit)).astype(np.int64))], names=["unit", "n", "new"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, place, line): repeated lines before one that repeated strings do not cover whole."""
    for batch in batches:
        x = _Lines(batch, "marks")
        at, _ = x.followers()
        at = at[x.repeated[at + 1] != _WHOLE]
        yield pa.RecordBatch.from_arrays([pa.array(x.unit[at]), pa.array(batch.column("place").to_numpy()[x.page[at]]), pa.array((at - x.first_line[x.page[at]]).astype(np.int32))], names=["unit", "place", "line"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec_id, line_no, from_word, to_word): lines outside the body, without words, and strings within lines of the body."""
    for batch in batches:
        x = _Lines(batch, "marks")
        heads = batch.column("headings")
        is_head = np.zeros(len(x.n), bool)
        n = heads.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        is_head[x.first_line[np.repeat(np.arange(x.pages), n)] + heads.flatten().to_numpy(zero_copy_only=False)] = True
        flags, repeated, head, first_line = x.flag.tolist(), x.repeated.tolist(), is_head.tolist(), x.first_line.tolist()
        outside = np.zeros(len(flags), bool)
        for k in range(x.pages):
            begin, end = first_line[k], first_line[k + 1]
            headline = next((j for j in range(begin, end) if flags[j] & _HEADLINE), -1)
            under = False
            for j in range(begin, end):
                flag, r = flags[j], repeated[j]
                if flag & _HEADLINE:
                    under = False
                elif r:
                    # under a heading a link with the section or reading time that others have as well is a link
                    under = under if r == _PART and under else head[j]
                    outside[j] = True
                else:
                    under = under and bool(flag & _TEASER)
                    outside[j] = under or j < headline
        at = np.flatnonzero(outside)
        # what is cut within lines of the body, in words of the line
        phrase = np.flatnonzero(x.cut & ~outside[x.line] & ((x.flag[x.line] & _HEADLINE) == 0))
        line = x.line[phrase]
        word = np.cumsum(x.size) - x.size
        begin = word[phrase] - word[x.start[line]]
        rec = batch.column("rec_id").to_numpy()[x.page[np.concatenate([at, line])]]
        none = np.zeros(len(at), bool)
        words = [pa.array(np.concatenate([np.zeros(len(at), np.int32), v.astype(np.int32)]), mask=np.concatenate([~none, np.zeros(len(phrase), bool)])) for v in (begin, begin + x.size[phrase])]
        yield pa.RecordBatch.from_arrays([pa.array(rec), pa.array(x.number[np.concatenate([at, line])].astype(np.int32)), *words], names=["rec_id", "line_no", "from_word", "to_word"])


def outside_body(store: DataFrame, least_pages: int = 3) -> DataFrame:
    """(rec_id, line_no, from_word, to_word): what is not main body, once per state. Without words it is a whole
    non-blank line, else the words from ``from_word`` to before ``to_word`` of a line that has other text as well.

    ``store`` has rec_id, url, title and content. States without id or content have no lines; a null url is a host of
    its own without name, a null title leaves the url to name the headline. Lines are numbered from 1 after cutting
    at the newline character, words from 0. A page with neither repeated lines nor links is all body. Two states of one
    rec_id with different contents are told apart.
    """
    rows = store.where("rec_id IS NOT NULL AND content IS NOT NULL").select(F.col("rec_id").cast("bigint").alias("rec_id"), "url", "title", "content")
    pages = write_stage(spread(rows).mapInArrow(_read_pages, _PAGE), "pages")
    runs = repeated_prefixes(pages, least_pages).select("place", (F.col("at") * 4 + F.col("depth")).alias("mark"))
    marks = runs.unionByName(_short_marks(pages, least_pages).toDF("place", "mark")).groupBy("place").agg(F.collect_set("mark").alias("marks"))
    marked = write_stage(pages.drop("host", "page").join(marks, "place", "left"), "marked")
    after = marked.mapInArrow(_followers, "unit bigint, n bigint, new bigint").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("new").alias("new"))
    headings = after.where((F.col("n") >= least_pages) & (F.col("new") >= HEADING_SHARE * F.col("n"))).select("unit")
    under = marked.mapInArrow(_candidates, "unit bigint, place bigint, line int").join(headings, "unit", "left_semi").groupBy("place").agg(F.collect_set("line").alias("headings"))
    return marked.join(under, "place", "left").mapInArrow(_decided, "rec_id bigint, line_no int, from_word int, to_word int").distinct()


def lines_outside_body(store: DataFrame, least_pages: int = 3) -> DataFrame:
    """(rec_id, line_no): each non-blank line of ``content`` that is not main body, once per state; see ``outside_body``."""
    return outside_body(store, least_pages).where("from_word IS NULL").select("rec_id", "line_no")


def _without(content: str, cuts: list[tuple[int, int | None, int | None]]) -> str:
    """The content without whole lines, and without stretches of words within lines."""
    whole, within = {n for n, b, _ in cuts if b is None}, {}
    for n, b, e in cuts:
        if b is not None:
            within.setdefault(n, []).append((b, e))
    out = []
    for n, line in enumerate(content.split("\n"), 1):
        if n in whole:
            continue
        if n in within:
            starts = [m.start() for m in _ONE_WORD.finditer(line)] + [len(line)]
            kept, at = [], 0
            for b, e in sorted(within[n]):
                kept.append(line[at : starts[b] if b else 0])
                at = starts[min(e, len(starts) - 1)]
            line = "".join([*kept, line[at:]])
        out.append(line)
    return "\n".join(out)


def main_body(store: DataFrame, least_pages: int = 3) -> DataFrame:
    """``store`` with ``body``: the content without what is outside the main body, ``lines_cut`` and ``strings_cut``.

    Other columns and repeated rows stay as they are; a null content has a null body.
    """
    cut = outside_body(store, least_pages).groupBy("rec_id").agg(F.collect_list(F.struct("line_no", "from_word", "to_word")).alias("_cut"))

    @F.pandas_udf("string")
    def body(content, cuts):
        return content.combine(cuts, lambda text, c: text if text is None or c is None else _without(text, [(int(x["line_no"]), x["from_word"], x["to_word"]) for x in c]))

    whole = F.size(F.filter("_cut", lambda c: c["from_word"].isNull()))
    joined = store.join(cut, "rec_id", "left")
    counted = joined.withColumn("lines_cut", F.coalesce(whole, F.lit(0))).withColumn("strings_cut", F.coalesce(F.size("_cut") - whole, F.lit(0)))
    return counted.withColumn("body", F.when(F.col("_cut").isNull(), F.col("content")).otherwise(body(F.col("content"), F.col("_cut")))).drop("_cut")
