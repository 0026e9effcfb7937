"""Template residue, filler text, error pages and script notices in documents.

Two kinds of evidence are combined. *Placeholder detectors* are patterns over title and text that an article does not
contain by itself: unfilled slots, filler text, and the messages of failing servers, programs and browsers, where they
stand as sentences of their own (an article that writes about an error names it in the middle of a sentence).
*Duplicated low-information responses* are texts, of any length, that hardly name what their url's slug and title name, and
whose sentences - names and numbers masked - are nearly all repeated by other documents, of several hosts or of many
different slugs and titles of one host; they count where a cue word of failing pages occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.session import spread, write_stage

# Words of the usual filler text.
FILLER_WORDS = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna
    aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute
    irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non
    proident sunt culpa qui officia deserunt mollit anim id est laborum""".split()
)
_FILLER_ONLY = FILLER_WORDS - set("do in non qui est et ex ad ut sit ea id eu sed esse nulla".split())

_SLOT_WORD = "insert|your|enter|add|placeholder|type|title|name|date|author|image|photo|caption|headline|quote|brand|price|product|tk|tbd"

_TAGS = "div|span|strong|small|code|pre|sub|sup|img|link|meta|html|head|header|body|main|nav|footer|section|article|aside|form|input|button|label|select|option|table|tbody|thead|tfoot|script|style|title|iframe|video|audio|source|figure|figcaption|picture|blockquote|cite|abbr|address|time|mark|del|ins|svg|path|font|center|col|area|base|param|canvas|details|summary|template"

# Slots of template languages and editors, anywhere in a text or title.
SLOTS = [
    r"\{\{[^{}\n]{0,80}\}\}",
    r"\{%[^{}\n]{1,80}%\}",
    r"\$\{[\w.|\- ]{1,60}\}",
    r"<%[^%\n]{0,80}%>",
    r"\[\[[\w.|\- ]{1,60}\]\]",
    r"(?<![\w%])%[a-z][a-z_.]{2,40}%",
    r"(?<![\w{$])\{[a-z][\w.]{1,40}\}",
    r"(?<!\w)__[a-z][\w.]{0,40}__(?!\w)",
    r"\((?!(?:more|much|still|yet|best|worst|worse|others?|lots|plenty|things?|and|is|was)\b)[a-z][\w.]*(?: [\w.]+)? to come\)",
    r"\btk tk\b",
    rf"\[\s*(?:{_SLOT_WORD})\b[^\]\n]{{0,60}}\]",
    r"\[[\w ]{0,40}\bhere\]",
    rf"<(?!(?:{_TAGS})>)[a-z][a-z_.]{{2,40}}>",
    r"\[object object\]",
    r"(?<![\w-])x{4,12}(?![\w-])",
    r"\b(?:title|headline|caption|name|quote|author|date|price|subtitle) tk\b",
    r"\b(?:dear|hello|hi|by|for|in|from|of|met|with|at|to|price|name|author|request:|name:|price:|author:|date:) (?:undefined|null|nan)(?=[\s,.;:!)]|$)",
    r", (?:undefined|null|nan) (?:is|was|has|will|and)\b",
    r"\b(?:text|title|content|copy|caption|description|headline|image|quote|name|paragraph|body) goes here\b",
]
# Sentences of editors, servers, programs and browsers; they begin a sentence or line.
NOTICES = [
    r"your (?:own )?(?:text|title|content|caption|headline) (?:goes )?here",
    r"click (?:here )?to (?:edit|add)\b",
    r"(?:type|write|enter|add) (?:a|your) (?:short )?(?:description|text|title|bio|caption)\b",
    r"(?:this is )?(?:a )?(?:sample|placeholder|dummy|filler|example) (?:text|copy|post|page|content|paragraph)\b",
    r"replace (?:it|this|me) with\b",
    r"test(?:ing)?(?:,? test(?:ing)?\b)+",
    r"this is your first (?:post|page)",
    r"lorem ipsum dolor",
    r"(?:error |http )?(?:4\d\d|5\d\d)(?: error)?\s*[-:–]?\s*(?:not found|forbidden|internal server|bad gateway|service unavailable|gateway time-?out|unauthorized|bad request|gone\b|too many requests|page not found|error\b)",
    r"(?:http )?error (?:4\d\d|5\d\d)(?:\W*$|\s*[-:–]?\s*(?:not found|page|the requested|forbidden))",
    r"service (?:temporarily )?unavailable",
    r"access denied(?:\W*$|\W+(?:your|you|the request))",
    r"(?:the )?page (?:was |is )?(?:not found|missing)\b",
    r"bad gateway|gateway time-?out|internal server error|request timed out|too many requests|connection (?:refused|reset|timed out)",
    r"traceback \(most recent",
    r"(?:php )?(?:warning|notice|fatal error|parse error|deprecated): .{0,160}\bon line \d+",
    r"(?:exception in thread|unhandled exception|uncaught \w*error|segmentation fault|stack trace)\b",
    r"\w*(?:error|exception): .{0,120}\b(?:at line|on line|in module|is not defined|of null|of undefined)\b",
    r"error (?:establishing|connecting|loading|opening)\b",
    r"(?:the )?upstream (?:host|server)\b",
    r"something went wrong\b|an (?:unexpected |unknown )?error (?:has )?occurred|oops\b.{0,60}\b(?:wrong|found|error|page)",
    r"the requested (?:address|url|page|resource|file)\b",
    r"(?:sorry,? )?the page .{0,80}(?:looking for|does not exist|doesn't exist|cannot be found|could not be found|has been (?:moved|removed|deleted))",
    r"sorry,? (?:the|this|that|but the|we) .{0,60}(?:not exist|not be found|no longer|unavailable|can't find|couldn't find)",
    r"we (?:can't|cannot|can not|couldn't|could not|can’t|couldn’t) (?:seem to )?(?:find|open|load|reach)\b",
    r"this .{0,60}\b(?:story|page|article|post|product|item|site|content|link) (?:is|was) (?:no longer|not|currently not|temporarily un?)\s?(?:available|found|online|there)",
    r"(?:it|this) may have (?:sold out|been moved|been deleted|expired)\b",
    r"try (?:again later|the search box|refreshing|reloading)\b",
    r"you (?:don't|do not|don’t) have permission\b",
    r"your (?:request|access|ip|address|connection)\b.{0,60}\b(?:has been|was|is) (?:blocked|denied|refused|limited)",
    r"checking (?:your|the) (?:browser|connection)\b|verify(?:ing)? (?:that )?you are (?:a )?human|just a moment(?:\.\.\.|…)\W*$|are you a robot|please complete the captcha",
    r"your session\b.{0,60}\bexpired|please (?:log|sign) in again",
    r".{0,60}\bis (?:down|offline|closed) for (?:scheduled )?maintenance",
    r"(?:please |kindly )?(?:enable|activate|turn on|switch on|allow) (?:javascript|java script|scripts?|scripting|cookies|active content)\b",
    r"you (?:need|have) to (?:enable|allow|turn on|switch on|activate|update)\b",
    r"java ?script (?:is|must be|has to be|seems to be|appears to be) (?:turned off|disabled|required|needed|off|enabled|switched off|not enabled|blocked)",
    r"(?:your|this) browser (?:is (?:out of date|outdated|not supported|too old|no longer|blocking|unsupported)|does not support|doesn't support|cannot|can't|has java)",
    r"(?:this|the) .{0,60}\b(?:page|site|app|gallery|shop)\b.{0,30}\b(?:works? only|requires?|needs?) .{0,40}(?:browser|scripts?|javascript|cookies)",
    r"if nothing happens\b|update it and allow\b",
    r"loading \S{1,30}(?: \S{1,20})?(?:\.\.\.|…)",
    # French, German, Spanish, Italian
    r"(?:veuillez|merci d'|merci de|vous devez) ?.{0,20}activer .{0,20}(?:javascript|scripts?|cookies)",
    r"(?:javascript|votre navigateur) (?:est désactivé|doit être activé|n'est (?:pas|plus)|ne prend pas)",
    r"(?:cette |la )?page .{0,60}(?:est |reste )?(?:introuvable|n'existe (?:pas|plus)|n'a pas été trouvée|non trouvée)|erreur (?:4\d\d|5\d\d|interne)|une erreur (?:est|s'est)|accès (?:refusé|interdit)|service (?:temporairement )?indisponible",
    r"bitte (?:aktivieren|schalten|erlauben) sie .{0,30}(?:javascript|skripte?|cookies)|(?:javascript|ihr browser) (?:ist (?:deaktiviert|ausgeschaltet|veraltet|nicht)|muss|wird nicht)",
    r"(?:die )?seite .{0,60}(?:nicht gefunden|existiert nicht|nicht verfügbar|wurde (?:verschoben|gelöscht))|(?:interner )?(?:serverfehler|fehler (?:4\d\d|5\d\d))|(?:es ist )?ein fehler (?:ist )?aufgetreten|zugriff (?:verweigert|gesperrt)|dienst nicht verfügbar",
    r"(?:por favor,? )?(?:active|activa|habilite|debe activar|es necesario activar|necesita activar) .{0,20}(?:javascript|scripts?|cookies)|(?:javascript|su navegador) (?:está (?:desactivado|obsoleto)|no (?:es|está|admite))|para ver .{0,60}(?:activ|habilit)\w+ .{0,15}javascript",
    r"(?:no se (?:encuentra|encontró|ha encontrado|pudo encontrar) (?:la|esta) página|(?:la )?página .{0,60}(?:no (?:encontrada|existe|se encuentra|está disponible)))|error (?:interno|4\d\d|5\d\d)\b(?:\W*$| del servidor)|se ha producido un error|acceso denegado|servicio no disponible",
    r"per (?:vedere|aprire|leggere|usare) .{0,60}javascript|(?:attiva|attivare|abilita|abilitare|è necessario attivare) .{0,20}(?:javascript|script|cookie)|(?:javascript|il (?:tuo|suo) browser) (?:è (?:disattivato|obsoleto)|non|deve)",
    r"(?:la |questa )?pagina .{0,60}(?:non (?:trovata|esiste|è (?:stata trovata|disponibile))|è stata (?:spostata|rimossa|eliminata))|errore (?:interno|4\d\d|5\d\d)|si è verificato un errore|accesso negato|servizio non disponibile",
]
# Titles that are nothing but such a message.
TITLES = [
    r"(?:error|http|fehler|erreur|errore)? ?(?:4\d\d|5\d\d)(?: error)?\W*",
    r"(?:4\d\d|5\d\d) ?[-–:|] ?.*",
    r"(?:page|seite|página|pagina)? ?(?:not found|nicht gefunden|introuvable|no encontrada|non trovata)\W*",
    r"(?:service (?:temporarily )?unavailable|access denied|forbidden|bad gateway|internal server error|just a moment|attention required|undefined|null|nan|none|untitled(?: document)? template)\W*",
    r"(?:please )?enable (?:javascript|scripts|cookies)\W*",
    r"(?:sample|test|example|dummy|placeholder) (?:post|page|title|text|entry|article)\W*\d*\W*|hello world\W*",
    r"<\w+>|lorem ipsum\W*|lorem ipsum dolor.*|tk|tktk|todo|tbd",
]

_SLOT = re.compile("|".join(SLOTS), re.I)
_NOTICE = re.compile("(?:" + "|".join(NOTICES) + ")", re.I)
_TITLE = re.compile("(?:" + "|".join(TITLES) + ")$", re.I)
#: Cheap cues, one of which every sentence with a slot or notice holds; the patterns run only over sentences with a cue.
CUES = """{ [ __ to|come) test|test test,|test testing|test testing,|test |tk a|bio short|text short|title short|bio short|caption example|paragraph n't|exist be|found been|moved been|removed
been|deleted can't|reach cannot|reach is|not was|not disponibile here] xxxx undefined null nan goes|here text|here title|here content|here caption|here
headline|here to|edit to|add description a|text your|text your|title your|bio a|title a|caption your|caption sample|text sample|copy
sample|post sample|page sample|content sample|paragraph placeholder dummy filler example|text example|copy example|post example|page
example|content replace|it replace|this replace|me first|post first|page lorem ipsum tempor eiusmod unavailable denied not|found page|missing
page|was page|is gateway server timed|out timeout time-out too|many refused reset traceback warning: notice: fatal|error parse|error
deprecated: exception uncaught segmentation stack|trace error: error|establishing error|connecting error|loading error|opening
upstream went|wrong error oops requested sorry looking|for not|exist can't|find cannot|find can|not couldn't could|not can't|seem
cannot|seem can't|open cannot|open can't|load cannot|load can’t couldn’t no|longer not|available not|online currently temporarily
may|have try|again try|the|search try|refreshing try|reloading permission blocked limited checking verify robot captcha
moment... moment… expired in|again maintenance script cookies active|content need|to have|to browser nothing|happens update|it loading forbidden
unauthorized bad|request gone javascript navigateur introuvable existe trouvée erreur refusé interdit indisponible
skript nicht|gefunden existiert nicht|verfügbar wurde|verschoben wurde|gelöscht fehler verweigert gesperrt navegador encuentra encontr
página|no denegado disponible activ habilit attiv abilit trovata esiste spostata rimossa eliminata errore negato % <""".replace("\n", " ").split()
#: Of cues that are common in prose: what must stand about their last letter, and how many letters before and after are read.
_NEAR = {
    "%": (re.compile(r"%[a-z_.]{3,}%"), 45, 45),
    "<": (re.compile(r"<(?:%|[a-z][a-z_.]*>)"), 0, 45),
    "[": (re.compile(rf"\[(?:\[|\s*(?:{_SLOT_WORD})\b|object object)"), 0, 160),
    **dict.fromkeys(["is|not", "was|not"], (re.compile(r"not\s?(?:available|found|online|there)"), 2, 14)),
}
_WEAK = re.compile(r"\b(?:available|found|loading|expired?|denied|blocked|wrong|error|page|browser|scripts?|server|reload|log ?in|sign in|broken|maintenance|unavailable|session|address|encuentra|página|gefunden|seite|trouv\w+|introuvable|erreur|pagina|trovata|errore|fehler|javascript|cookies)\b", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[\r\n]+|(?<=[.!?…])[\"”»’')\]]*\s+")
_SENTENCE = re.compile(r"[\s\S]+?(?:[.!?…](?=[\"”»’')\]]*\s)[\"”»’')\]]*\s+|[\r\n]+|$)")
_EDGE = re.compile(r"^[\s>*\-–—•·#|\"“«'(]+")
_MASK = re.compile(r"\d+|\b[^\W\d_]*[A-Z][^\W_]*", re.U)
_SPACE = re.compile(r"[ \t  ]+")

#: Share of a response's letters that must lie in sentences repeated elsewhere.
REPEATED_SHARE = 0.8

_OUT = pa.schema([("doc_id", pa.int64()), ("host", pa.int64()), ("name", pa.int64()), ("strong", pa.bool_()), ("weak", pa.bool_()), ("parts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])


def cue_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for cue in {*CUES, *_FILLER_ONLY}:
        a.add_word(cue.replace("|", " "), cue)
    a.make_automaton()
    return a


def _is_cue(low: str, end: int, cue: str) -> bool:
    """Whether the cue that ends here counts: a filler word as a whole word, others where ``_NEAR`` asks for no more."""
    if cue in _FILLER_ONLY:
        begin = end - len(cue)
        return not (low[end + 1 : end + 2].isalpha() or begin >= 0 and low[begin].isalpha())
    if cue in _NEAR:
        pattern, before, after = _NEAR[cue]
        return pattern.search(low, max(0, end - before), end + after) is not None
    return True


def is_filler(segment: str) -> bool:
    """Whether most words of a segment are those of the usual filler text, at least five of them only used there."""
    words = [w.lower() for w in _WORD.findall(segment)]
    own = sum(w in _FILLER_ONLY for w in words)
    return own >= 5 and 2 * sum(w in FILLER_WORDS for w in words) >= 1.2 * len(words)


def _in_segment(segment: str) -> bool:
    s = _SPACE.sub(" ", segment)
    return bool(_SLOT.search(s) or _NOTICE.match(_EDGE.sub("", s))) or is_filler(s)


def has_residue(text: str | None, title: str | None = None, automaton: ahocorasick.Automaton | None = None) -> bool:
    """Whether a detector fires on the text's sentences or the title. With an automaton of the cues only the sentences
    that hold a cue are tried."""
    if title:
        t = _SPACE.sub(" ", title).strip()
        if _TITLE.match(t) or _SLOT.search(t) or is_filler(t):
            return True
    if not text:
        return False
    if automaton is None:
        return any(_in_segment(s) for s in _BREAK.split(text) if s)
    plain = _SPACE.sub(" ", text) if "  " in text or "\t" in text or "\u00a0" in text else text
    low = plain.lower()
    if len(low) != len(plain):  # a letter whose lower case is longer: places don't carry over
        plain = low
    done = 0
    for end, cue in automaton.iter(low):
        if end < done or not _is_cue(low, end, cue):
            continue
        start = max(done, low.rfind("\n", 0, end) + 1)
        stop = low.find("\n", end)
        stop = len(low) if stop < 0 else stop
        for m in _SENTENCE.finditer(plain, start, stop):
            if m.end() > end:
                if _in_segment(m[0]):
                    return True
                done = m.end()
                break
        else:
            done = stop
    return False


def _off_topic(slug: str, title: str | None, low: str) -> bool:
    """Whether a text in lower case holds less than half of the terms of its url's slug and title."""
    named = {w for w in _WORD.findall(f"{slug} {title or ''}".lower()) if len(w) > 3}
    return 2 * sum(w in low for w in named) < len(named) if named else True


def _part(sentence: str) -> int:
    """Fingerprint of a sentence, its names and numbers masked where that leaves at least four words of it."""
    s = _SPACE.sub(" ", sentence).strip()
    masked = _MASK.sub("#", s.lower() if s.isupper() else s)
    return xxhash.xxh3_64_intdigest((masked if len(_WORD.findall(masked)) >= 4 else s).lower()) >> 1


def _host(url: str | None, source: str | None) -> int:
    host = re.match(r"\s*[A-Za-z][\w+.-]*://([^/?#]*)", url or "")
    return xxhash.xxh3_64_intdigest((host[1] if host else source or "").strip().lower()) >> 1


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = cue_automaton()
    for batch in batches:
        ids = batch.column(0)
        for at in range(0, batch.num_rows, 500):
            rows = []
            for url, title, source, text in zip(*(batch.column(k).slice(at, 500).to_pylist() for k in (1, 2, 3, 4))):
                strong = has_residue(text, title, automaton)
                slug = re.sub(r"^.*/", "", (url or "").split("?")[0].split("#")[0].rstrip("/")).replace("-", " ")
                weak = bool(text) and not text.isspace() and _off_topic(slug, title, text.lower()) and _WEAK.search(text) is not None
                if weak:
                    sentences = [s for s in _BREAK.split(text) if s.strip()]
                    rows.append((_host(url, source), xxhash.xxh3_64_intdigest(f"{slug}\n{title}".lower()) >> 1, strong, True, [*map(_part, sentences)], [*map(len, sentences)]))
                else:
                    rows.append((None, None, strong, False, None, None))
            yield pa.RecordBatch.from_arrays([ids.slice(at, 500), *(pa.array([r[k] for r in rows], type=_OUT.field(k + 1).type) for k in range(6))], schema=_OUT)


def residue(docs: DataFrame, least_hosts: int = 2, least_documents: int = 4) -> DataFrame:
    """(doc_id, reason): documents with residue in text or title, once each; reason is 'detector', 'duplicate' or 'both'.

    ``docs`` has doc_id, url, title, source and text. Null or blank texts have a case only through the title; null
    titles are no case. A duplicate is a text off its title and url with a cue word, of which ``REPEATED_SHARE`` lies in masked
    sentences that occur in ``least_documents`` documents, of ``least_hosts`` hosts or of as many slugs and titles as documents.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "url", "title", "source", "text")
    found = write_stage(spread(rows).mapInArrow(_evidence, "doc_id bigint, host bigint, name bigint, strong boolean, weak boolean, parts array<bigint>, sizes array<int>").where("strong OR weak"), "residue")
    parts = found.where("weak").select("doc_id", "host", "name", F.inline(F.arrays_zip(F.col("parts").alias("part"), F.col("sizes").alias("size")))).distinct()
    counts = parts.groupBy("part").agg(F.count_distinct("doc_id").alias("d"), F.count_distinct("host").alias("h"), F.count_distinct("name").alias("names"))
    common = counts.where((F.col("d") >= least_documents) & ((F.col("h") >= least_hosts) | (F.col("names") >= least_documents))).select("part", F.lit(1).alias("common"))
    doubled = parts.join(common, "part", "left").groupBy("doc_id").agg(F.sum("size").alias("n"), F.sum(F.col("size") * F.coalesce("common", F.lit(0))).alias("c")).where(F.col("c") >= REPEATED_SHARE * F.col("n")).select("doc_id", F.lit("duplicate").alias("reason"))
    both = found.where("strong").select("doc_id", F.lit("detector").alias("reason")).unionByName(doubled).groupBy("doc_id").agg(F.min("reason").alias("low"), F.max("reason").alias("high"))
    return both.select("doc_id", F.when(F.col("low") != F.col("high"), "both").otherwise(F.col("low")).alias("reason"))
