"""Per-document text statistics that tell prose from lists, tables and junk.

Every statistic gets one mergeable quantile sketch per language, and one over all languages; a document's values become
percentiles and robust z-scores. The spread is measured by the sketch, on the side of the median that is away from the
statistic's tail of junk, so that up to half of a language may be junk without widening it; to it is added the error that a
share has in a text of this length. A document is in the tail of a statistic if it lies beyond ``TAIL_Z`` of its
language, or of all languages where its own is full of such texts or has hardly any. What is reported as no prose lies in
a tail and is for more than half entries, strange word pairs or repetition. Next to the usual figures
(words, word length, symbols, line ends, common words) three shares measure that:

* ``entry_share``: characters in lines of entries, values or characters against those in lines of sentences, judged
  line by line by separators, symbols, known words, sentence ends and words that make clauses;
* ``strange_share``: neighbouring known words of which one is a common word, and whose pair the collection hardly ever
  holds: words strung together without making sentences;
* ``repeat_share``: words that only repeat others.

Known words, usual pairs and page furniture (long lines that many documents share) are counted by language, furniture
also by source; what is kept has a document share of at least ``KEEP_SHARE`` of all documents or of its language's (of
furniture ``SOURCE_SHARE`` of its source's). A document has a bounded number of different words, so these are for each
group at most (mean different keys per document) / share keys, however large the collection. A language whose
documents hold too few known words is not asked for unknown ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm import residue
from heddle.session import spread, write_stage

#: Least share of documents of a kept word, pair or line; words need twice this share.
KEEP_SHARE, KEEP_LEAST = 0.0005, 4
#: Least share and number of a source's documents that hold a line of its furniture.
SOURCE_SHARE, SOURCE_LEAST = 0.01, 10
#: Share of a language's different words per document that must be known, for its lines to be judged by unknown words.
LEAST_KNOWN = 0.3
#: Share of vowels among Latin letters below which a line of unknown words is none in any language.
LEAST_VOWELS = 0.27
#: Robust z-score from which a value is in the tail, and on which side a statistic's tail holds junk.
TAIL_Z = 3.5
TAIL_SIDE = {"mean_word_length": 1, "symbol_ratio": 1, "line_end_share": -1, "common_share": -1, "entry_share": 1, "strange_share": 1, "repeat_share": 1}
#: "For more than half": the shares that tell what a text is for, and the half.
DECIDING, HALF = ("entry_share", "strange_share", "repeat_share"), 0.5
STATISTICS = ("word_count", "mean_word_length", "symbol_ratio", "line_end_share", "common_share", "entry_share", "strange_share", "repeat_share")
#: Kept keys that are sent to all executors (8 bytes each); more are an error that asks for greater shares.
MOST_KEYS = 1 << 24
#: Languages and sources whose sizes are sent to all executors; more are joined by a shuffle, which gives the same.
MOST_GROUPS = 1 << 18

# Words that make clauses (verbs, pronouns, negations, conjunctions) in five languages.
CLAUSE_WORDS = frozenset(
    """is was are were be been has have had will would can could may might must shall should do does did not no nobody
    nothing it its they their them he she his her him we us our you your i that which who whose whom what when where why
    how if because though although while than so yet still until unless there this these those says said told asked
    never always
    est sont était ont avait que qui qu ne pas il elle ils elles on nous vous se où mais c quand jamais rien plus sa son
    ses leur
    ist sind war hat haben hatte wird werden nicht kein keinen sich er sie es man dass weil wenn aber nie noch auch wie
    wer dem
    está era ha han había quien cuando pero les nunca sus más como
    è sono hanno aveva non si che chi ma gli loro suo sua mai perché""".split()
)

_WORD = re.compile(r"[^\W\d_]+")
_WORD_OR_LINE, _ASCII_OR_LINE = re.compile(r"[^\W\d_]+|\n"), re.compile(r"[a-z]+|\n")
_END = re.compile(r"[.!?…][\"”»’')\]]*\s*$")
_STOP = re.compile(r"[.!?…][\"”»’')]*(?:\s|$)")
_MARK = re.compile(r"\s*(?:[-*•–·>]+\s+|\(?[0-9]{1,3}[.)]\s+|\(?[a-z][.)]\s+)")
_SPOKEN = re.compile(r"\s*(?:>\s*)?\[\d\d?:\d\d(?::\d\d)?\]\s*(?:[^:\n]{2,50}:)?\s*")
_CELL = re.compile(r"[|;\t]|\s{2,}| / |\bn/a\b")
_VALUE_END = re.compile(r"(?:\d|%|[-–]|n/a)\)?$")
_BREAK = re.compile(r"[\r\n]+")
_LATIN, _VOWEL = re.compile("[a-zà-ɏ]"), re.compile("[aeiouyà-æè-ïò-öø-üýÿāăąēĕėęěĩīĭįıōŏőœũūŭůűų]")
_COMMON, _CLAUSE = 2, 4  # low bits of a word's hash: common word, word that makes clauses
_PAIR = np.int64(0x9E3779B97F4A7C1)
#: Texts and characters measured at once; a longer text is measured by itself.
STEP, STEP_CHARS = 500, 1 << 22


class _Hashes(dict):
    """64-bit hashes of lower-case words; low bits say what kind of word it is."""

    def __init__(self, common: frozenset[str]):
        super().__init__({"\n": 0})
        self.common = common

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
            self["\n"] = 0
        h = xxhash.xxh3_64_intdigest(word) & ~7 | (_COMMON if word in self.common else 0) | (_CLAUSE if word in CLAUSE_WORDS else 0)
        self[word] = h = h - (1 << 64) if h >= 1 << 63 else h
        return h


class _Tokens:
    """Words of the lines of some texts, as arrays over all of them."""

    def __init__(self, texts: list[list[str]], hashes: _Hashes):
        self.lines = [x for text in texts for x in text]
        words: list[str] = []
        for text in texts:
            if text:
                low = "\n".join(text).lower()
                words += (_ASCII_OR_LINE if low.isascii() else _WORD_OR_LINE).findall(low)
                words.append("\n")
        hashed = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        line_end = hashed == 0
        ends = np.flatnonzero(line_end)
        self.n = np.diff(np.append(-1, ends)) - 1
        self.stop = np.cumsum(self.n)
        self.start = self.stop - self.n
        self.doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])  # of each line
        self.hash, self.size = hashed[~line_end], sizes[~line_end]
        self.of = np.repeat(self.doc, self.n)  # text of each word

    def per_line(self, values: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values))
        return total[self.stop] - total[self.start]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of words whose follower is in the same text where one of both is common, and the pairs' hashes."""
        a, b = self.hash[:-1], self.hash[1:]
        at = np.flatnonzero((((a | b) & _COMMON) != 0) & (self.of[1:] == self.of[:-1]))
        return at, (a[at] * _PAIR + b[at]) | 1

    def keys(self) -> np.ndarray:
        """Fingerprints of lines that may be furniture: five words or more; else 0."""
        place = np.arange(len(self.hash)) - np.repeat(self.start, self.n)
        powers = np.cumprod(np.full(int(self.n.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
        total = np.append(np.uint64(0), np.cumsum(self.hash.view(np.uint64) * powers[place]))
        key = (total[self.stop] - total[self.start]) * np.uint64(0xFF51AFD7ED558CCD)
        return np.where(self.n >= 5, (key ^ (key >> np.uint64(29))) & ~np.uint64(7) | np.uint64(3), np.uint64(0)).view(np.int64)


def _steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Begin and end of stretches of texts that are handled at once."""
    begin, chars = 0, 0
    for k, x in enumerate(texts):
        size = len(x or "")
        if k > begin and (k - begin == STEP or chars + size > STEP_CHARS):
            yield begin, k
            begin, chars = k, 0
        chars += size
    if begin < len(texts):
        yield begin, len(texts)


def _group(name: str | None) -> int:
    """A language's or source's number, which leaves a key's low bits as they are; 0 without a name."""
    h = xxhash.xxh3_64_intdigest(name) & ~7 if name else 0
    return h - (1 << 64) if h >= 1 << 63 else h


#: Keys of a group's number of documents and of their different words.
_DOCUMENTS, _WORDS = 0, 8


def _counter(common: frozenset[str]):
    """(group, key, n): documents with a key, by language (even groups); lines also by source (odd groups)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(common)
        for batch in batches:
            found = []
            texts = batch.column(0).to_pylist()
            groups = np.array([_group(x) for x in batch.column(1).to_pylist()], np.int64)
            sources = np.array([_group(x) | 1 for x in batch.column(2).to_pylist()], np.int64)
            for begin, end in _steps(texts):
                by_lang = begin + np.argsort(groups[begin:end], kind="stable")  # texts of a language come together
                lang, source = groups[by_lang], sources[by_lang]
                t = _Tokens([_BREAK.split(texts[k]) for k in by_lang.tolist()], hashes)
                place, pairs = t.pairs()
                keys = t.keys()
                lines, line_of = keys[keys != 0], t.doc[keys != 0]
                key = np.concatenate([t.hash, pairs, lines])
                of = np.concatenate([t.of, t.of[place], line_of])
                # sorted by key and text, equal (key, text) come together
                order = np.lexsort((of, key))
                key, of = key[order], of[order]
                first = np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])) if len(key) else np.zeros(0, bool)
                key, of = key[first], of[first]
                found.append(_runs(lang[of], key))
                found.append((lang, np.full(len(lang), _DOCUMENTS), np.ones(len(lang), np.int64)))
                found.append((lang, np.full(len(lang), _WORDS), np.bincount(of[(key & 1) == 0], minlength=len(lang))))
                order = np.lexsort((line_of, lines))
                lines, line_of = lines[order], line_of[order]
                first = np.append(True, (lines[1:] != lines[:-1]) | (line_of[1:] != line_of[:-1])) if len(lines) else np.zeros(0, bool)
                named = source != 1
                found.append(_runs(*(x[named[line_of[first]]] for x in (source[line_of[first]], lines[first]))))
                found.append((source[named], np.full(int(named.sum()), _DOCUMENTS), np.ones(int(named.sum()), np.int64)))
            if found:
                group, key, n = (np.concatenate([x[k] for x in found]) for k in range(3))
                order = np.lexsort((group, key))
                group, key, n = group[order], key[order], n[order]
                head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(group[head]), pa.array(key[head]), pa.array(np.add.reduceat(n, head))], names=["grp", "key", "n"])

    return count


def _runs(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups, keys and lengths of the runs of equal ones."""
    head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))) if len(key) else np.zeros(0, np.int64)
    return group[head], key[head], np.diff(np.append(head, len(key)))


def _among(keys: np.ndarray, kept: np.ndarray) -> np.ndarray:
    if not len(kept):
        return np.zeros(len(keys), bool)
    return kept[np.minimum(np.searchsorted(kept, keys), len(kept) - 1)] == keys


def _join_lines(text: str) -> list[str]:
    """The non-blank lines; a line that goes on with the sentence of the line before is joined to it."""
    lines: list[list[str]] = []
    for x in _BREAK.split(text):
        if not x or x.isspace():
            continue
        if x[0].islower() and lines and not _MARK.match(x) and not _END.search(lines[-1][-1]):
            last = lines[-1][-1]
            if x.count(" ") >= 3 and last.count(" ") >= 3 and not _CELL.search(last.strip()) and not _CELL.search(x.strip()):
                lines[-1][-1] = last.rstrip()
                lines[-1].append(x)
                continue
        lines.append([x])
    return [x[0] if len(x) == 1 else " ".join(x) for x in lines]


class _Profile:
    def __init__(self, common: frozenset[str], usual: np.ndarray, known: np.ndarray, own: np.ndarray, own_known: np.ndarray, unsure: frozenset[int]):
        """Sorted keys of all documents; keys of groups, each mixed with its group; groups that know too few words."""
        self.hashes = _Hashes(common)
        self.usual, self.known, self.own, self.own_known, self.unsure = usual, known, own, own_known, unsure

    @staticmethod
    def among(keys: np.ndarray, everywhere: np.ndarray, groups: np.ndarray, own: np.ndarray) -> np.ndarray:
        hit = _among(keys, everywhere)
        rest = np.flatnonzero(~hit)
        hit[rest] = _among(keys[rest] ^ groups[rest], own)
        return hit

    def line(self, line: str) -> str:
        """p: sentences, l: entries, values or characters, u: can't be told from this line alone, n: nothing."""
        m = _SPOKEN.match(line)
        if m is not None:
            return "p" if _WORD.search(line, m.end()) else "n"
        m = _MARK.match(line)
        body = line[m.end() :].strip() if m else line.strip()
        words = _WORD.findall(body.lower())
        solid = len(body) - body.count(" ")
        if not solid:
            return "n"
        letters = sum(map(len, words))
        symbols = solid - letters - sum(map(str.isdigit, body)) if letters < 0.86 * solid else 0
        if "://" in body or symbols > 0.14 * solid and solid >= 20 and symbols > 0.9 * len(words):
            return "l"
        if letters >= 20 and letters > 14 * len(words):
            return "l"
        cells = len(_CELL.findall(body))
        if cells >= 2 and cells * 7 > len(words):
            return "l"
        end = _END.search(body) is not None
        if not end and len(words) <= 12 and _VALUE_END.search(body):
            return "u"
        clauses = sum(w in CLAUSE_WORDS for w in words)
        if clauses * 25 >= len(words) and clauses and (end and len(words) >= 3 or len(words) >= 11):
            return "p"
        if m is None:
            stops = len(_STOP.findall(body))
            if stops >= 2 and 2 * stops <= len(words) + 2 or end and len(words) >= 8:
                return "p"
            if len(words) >= 20 and sum(self.hashes[w] & _COMMON != 0 for w in words) >= 0.2 * len(words):
                return "p"
        return "u"

    def kinds(self, t: _Tokens, known: np.ndarray, langs: np.ndarray, sources: np.ndarray) -> list[str]:
        """The kind of each line; f is furniture."""
        letters, said = t.per_line(t.size), t.per_line(t.size * (known & (t.size > 1)))
        clauses = t.per_line((t.hash & _CLAUSE) != 0)
        furniture = self.among(t.keys(), self.usual, sources[t.doc] & ~1, self.own)
        sure = np.array([x not in self.unsure for x in langs.tolist()], bool)
        strange = (t.n >= 5) & (said < 0.3 * letters) & sure[t.doc]
        # a sentence in a language that the collection hardly holds has unknown words as well, but vowels
        for k in np.flatnonzero(strange).tolist():
            low = t.lines[k].lower()
            latin, vowels = len(_LATIN.findall(low)), len(_VOWEL.findall(low))
            strange[k] = 2 * latin > letters[k] and vowels < LEAST_VOWELS * latin
        # sentences that leave no doubt: many words, clauses, hardly a symbol
        clear = ((clauses * 25 >= t.n) & (clauses > 0) & (t.n >= 11) & (letters <= 14 * t.n)).tolist()
        out = []
        for x, is_furniture, is_strange, is_clear, n in zip(t.lines, furniture.tolist(), strange.tolist(), clear, letters.tolist()):
            if is_furniture:
                out.append("f")
            elif is_clear and not is_strange and x[0].isalpha() and n >= 0.86 * (len(x) - x.count(" ")) and "  " not in x and "|" not in x and "\t" not in x and x.count(";") < 2 and " / " not in x:
                out.append("p")
            elif is_strange and not _SPOKEN.match(x):
                out.append("l")
            else:
                out.append(self.line(x))
        return out

    def measure(self, texts: list[str], langs: list[str], sources: list[str | None]) -> np.ndarray:
        """One row of the statistics for each text."""
        lang, source = (np.array([_group(x) for x in names], np.int64) for names in (langs, sources))
        out = np.zeros((len(texts), len(STATISTICS)))
        t = _Tokens([_join_lines(x) for x in texts], self.hashes)
        docs = len(texts)
        words = np.bincount(t.of, minlength=docs)
        some = np.maximum(words, 1)
        letters = np.bincount(t.of, weights=t.size, minlength=docs)
        solid = np.array([len(x) - sum(map(x.count, " \n\r\t")) for x in texts])
        known = self.among(t.hash, self.known, lang[t.of], self.own_known)
        out[:, 0], out[:, 1] = words, letters / some
        out[:, 2] = np.where(solid > 0, np.clip(1 - letters / np.maximum(solid, 1), 0, 1), 0)
        out[:, 4] = np.bincount(t.of, weights=(t.hash & _COMMON) != 0, minlength=docs) / some
        # pairs of known words
        at, pairs = t.pairs()
        judged = known[at] & known[at + 1]
        of = t.of[at[judged]]
        odd = ~self.among(pairs[judged], self.usual, lang[of], self.own)
        n = np.bincount(of, minlength=docs)
        out[:, 6] = np.where(n >= 8, np.bincount(of, weights=odd, minlength=docs) / np.maximum(n, 1), 0)
        # words of windows of 200 are compared, so that length alone repeats nothing; prose repeats up to three of five
        place = np.arange(len(t.of)) - (np.cumsum(words) - words)[t.of]
        window = t.of * ((int(words.max(initial=0)) // 200) + 1) + place // 200
        both = np.sort((window.astype(np.uint64) << np.uint64(40)) | (t.hash.view(np.uint64) >> np.uint64(24)))
        distinct = np.append(True, both[1:] != both[:-1]) if len(both) else np.zeros(0, bool)
        of = (both >> np.uint64(40)).astype(np.int64) // ((int(words.max(initial=0)) // 200) + 1)
        repeat = 1 - np.bincount(of, weights=distinct, minlength=docs) / some
        out[:, 7] = np.where(words >= 20, np.maximum(0, (repeat - 0.6) / 0.4), 0)
        kinds = self.kinds(t, known, lang, source)
        first = np.searchsorted(t.doc, np.arange(docs + 1)).tolist()
        for k in range(docs):
            lines = t.lines[first[k] : first[k + 1]]
            out[k, 5] = _entry_share(kinds[first[k] : first[k + 1]], [len(x.strip()) for x in lines])
            out[k, 3] = sum(_END.search(x, max(0, len(x) - 12)) is not None for x in lines) / max(1, len(lines))
        return out


def _entry_share(kinds: list[str], sizes: list[int]) -> float:
    """Characters in entries against those in entries and sentences."""
    entries = sum(n for k, n in zip(kinds, sizes) if k == "l")
    sentences = sum(n for k, n in zip(kinds, sizes) if k == "p")
    at = 0
    while at < len(kinds):  # lines that can't be told: three in a row, most of a text, or long ones are entries
        if kinds[at] != "u":
            at += 1
            continue
        end = at
        while end < len(kinds) and kinds[end] in "unf":
            end += 1
        run = [n for k, n in zip(kinds[at:end], sizes[at:end]) if k == "u"]
        if len(run) >= 3 or 2 * len(run) > len(kinds) or sum(run) > 300:
            entries += sum(run)
        at = end
    return entries / (entries + sentences) if entries + sentences else 0.0


def _measure(common: frozenset[str], kept):
    deciding = [STATISTICS.index(s) for s in DECIDING]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile, cues = _Profile(common, *kept.value), residue.cue_automaton()
        for batch in batches:
            all_texts = [x or "" for x in batch.column("text").to_pylist()]
            for begin, end in _steps(all_texts):
                part, texts = batch.slice(begin, end - begin), all_texts[begin:end]
                values = profile.measure(texts, part.column("lang").to_pylist(), part.column("source").to_pylist())
                near = (values[:, deciding] > HALF).any(axis=1)
                left = [residue.has_residue(x, t, cues) if c else None for x, t, c in zip(texts, part.column("title").to_pylist(), near.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *map(pa.array, values.T), pa.array(left, pa.bool_())], names=["doc_id", "lang", *STATISTICS, "residue"])

    return run


def language(lang: Column) -> Column:
    """Two or three letters in lower case, else 'und'; thus a bounded number of languages."""
    code = F.lower(F.trim(lang))
    return F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise("und")


def _checked(keys: DataFrame) -> DataFrame:
    keys = write_stage(keys, "kept")
    if keys.count() > MOST_KEYS:
        raise ValueError(f"over {MOST_KEYS} words, pairs and lines are kept; KEEP_SHARE and SOURCE_SHARE must be greater")
    return keys


def statistics(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, lang, the statistics, residue) of every document with an id; null and blank texts have zeros.

    ``docs`` has doc_id, lang, title and text, and source where furniture is to be counted by source; ``common_words``
    has word; other columns are ignored. ``residue`` tells of
    a document that is for more than half no prose whether a residue detector fires; it is null for others. A document given twice has two rows.
    """
    spark = docs.sparkSession
    # a word list by hand: its size is checked
    words = [r[0] for r in common_words.where("word IS NOT NULL").select(F.lower(F.trim("word"))).distinct().limit(100_001).collect()]
    if len(words) > 100_000:
        raise ValueError("common_words is meant to hold the frequent words of each language, at most 100000")
    common = frozenset(words)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), language(F.col("lang")).alias("lang"), "title", "text", (F.lower(F.trim("source")) if "source" in docs.columns else F.lit(None).cast("string")).alias("source"))
    rows = spread(rows)
    counts = rows.where("text IS NOT NULL AND length(trim(text)) > 0").select("text", "lang", "source").mapInArrow(_counter(common), "grp bigint, key bigint, n bigint").groupBy("grp", "key").agg(F.sum("n").alias("n"))
    counts = write_stage(counts, "keys")
    of_lang, totals = counts.where("grp % 2 = 0"), F.col("key").isin(_DOCUMENTS, _WORDS)
    documents = of_lang.where(F.col("key") == _DOCUMENTS).agg(F.sum("n")).first()[0] or 0
    all_keys = of_lang.where(~totals).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(KEEP_LEAST, KEEP_SHARE * documents))
    all_keys = _checked(all_keys.select("key", (F.col("n") >= 2 * KEEP_SHARE * documents).alias("often"))).toArrow()
    keys, often = (all_keys.column(k).to_numpy() for k in (0, 1))
    # 'und' is no language: its documents are compared with all
    sizes = counts.where(F.col("key") == _DOCUMENTS).select("grp", F.col("n").alias("size"))
    own = counts.where(~totals & (F.col("grp") != _group("und"))).join(F.broadcast(sizes) if sizes.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS else sizes, "grp")
    odd = F.col("grp") % 2 != 0
    least = F.when(odd, F.greatest(F.lit(float(SOURCE_LEAST)), SOURCE_SHARE * F.col("size"))).otherwise(F.greatest(F.lit(float(KEEP_LEAST)), KEEP_SHARE * F.col("size")))
    word = ~odd & (F.col("key") % 2 == 0) & (F.col("n") >= F.greatest(F.lit(float(KEEP_LEAST)), 2 * KEEP_SHARE * F.col("size")))
    # a key and its group travel as one number
    mixed = F.col("key").bitwiseXOR(F.col("grp").bitwiseAND(F.lit(-2)))
    own_keys = _checked(own.where(F.col("n") >= least).select("grp", mixed.alias("mixed"), word.alias("known"), "n"))
    held = {g: n for g, n in own_keys.where("known").groupBy("grp").agg(F.sum("n")).collect()}  # one row per language
    words = of_lang.where((F.col("key") == _WORDS) & (F.col("grp") != _group("und"))).select("grp", "n").collect()
    unsure = frozenset(g for g, k in words if held.get(g, 0) < LEAST_KNOWN * k)
    mixed_keys = own_keys.select("mixed", "known").toArrow()
    own_sorted, is_known = (mixed_keys.column(k).to_numpy() for k in (0, 1))
    sent = spark.sparkContext.broadcast((np.sort(keys), np.sort(keys[often]), np.sort(own_sorted), np.sort(own_sorted[is_known]), unsure))
    schema = "doc_id bigint, lang string, " + ", ".join(f"{s} double" for s in STATISTICS) + ", residue boolean"
    return rows.mapInArrow(_measure(common, sent), schema)


def _z(s: str, of: str) -> Column:
    """The robust z-score of a statistic against the median and spread of ``of``, its own language or all."""
    n, mid = F.greatest("word_count", F.lit(1.0)), F.col(f"{of}{s}_mid")
    p = (mid * n + 1) / (n + 2)
    chance = {"word_count": F.greatest(mid, F.lit(1.0)), "mean_word_length": F.greatest(mid, F.lit(1.0)) / n}.get(s, p * (1 - p) / n)
    return (F.col(s) - mid) / F.sqrt(F.col(f"{of}{s}_dev") * F.col(f"{of}{s}_dev") + chance)


def profiles(measured: DataFrame) -> DataFrame:
    """Adds to rows of ``statistics`` each one's percentile ``<name>_pct`` and robust z-score ``<name>_z`` within the
    language, ``tails``: the statistics in whose tail of junk the document lies, and ``no_prose``: whether there is one and
    the text is for more than ``HALF`` entries, strange pairs or repetition."""
    k = F.lit(200)
    of_lang = measured.groupBy("lang").agg(*[F.kll_sketch_agg_double(s, k).alias(s) for s in STATISTICS])
    of_all = measured.agg(*[F.kll_sketch_agg_double(s, k).alias(s) for s in STATISTICS])

    def marks(sketches: DataFrame, of: str) -> list[Column]:
        q = lambda s, p: F.kll_sketch_get_quantile_double(F.col(s), F.lit(p))
        away = lambda s: q(s, 0.5) - q(s, 0.25) if TAIL_SIDE.get(s, 1) > 0 else q(s, 0.75) - q(s, 0.5)
        return [x for s in STATISTICS for x in (q(s, 0.5).alias(f"{of}{s}_mid"), (away(s) / 0.6745).alias(f"{of}{s}_dev"))]

    points = F.lit([p / 100 for p in range(101)])
    steps = [F.kll_sketch_get_quantile_double(F.col(s), points).alias(f"_{s}") for s in STATISTICS]
    own = of_lang.select("lang", *steps, *marks(of_lang, "_own_"))
    # one row, and at most one row for each of 26^2 + 26^3 + 1 languages
    joined = measured.join(F.broadcast(own), "lang").join(F.broadcast(of_all.select(*marks(of_all, "_all_"))), F.lit(True))
    beyond = lambda s: F.greatest(F.lit(TAIL_SIDE[s]) * _z(s, "_own_"), F.lit(TAIL_SIDE[s]) * _z(s, "_all_")) > TAIL_Z
    tails = F.filter(F.array(*[F.when(beyond(s), s) for s in TAIL_SIDE]), lambda x: x.isNotNull())
    # prose repeats itself as well: repetition counts beyond what is usual in the language, or in all
    usual = F.least("_own_repeat_share_mid", "_all_repeat_share_mid")
    half = (F.greatest("entry_share", "strange_share") > HALF) | (F.col("repeat_share") > usual + HALF)
    pct = lambda s: F.least(F.size(F.filter(f"_{s}", lambda step: step < F.col(s))), F.lit(100)).cast("double")
    out = joined.select("doc_id", "lang", *STATISTICS, *[pct(s).alias(f"{s}_pct") for s in STATISTICS], *[_z(s, "_own_").alias(f"{s}_z") for s in STATISTICS], tails.alias("tails"), "residue", half.alias("_half"))
    return out.withColumn("no_prose", (F.size("tails") > 0) & F.col("_half")).drop("_half")


def not_prose(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id): documents in the tails that are no prose, without template residue, once each. Null and blank texts are never
    among them."""
    measured = write_stage(statistics(docs, common_words), "statistics")
    return profiles(measured).where("no_prose AND NOT coalesce(residue, false)").select("doc_id").distinct()
