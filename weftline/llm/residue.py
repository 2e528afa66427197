"""Template residue and error pages.

Slots: texts made from one template agree but for the fillers of its slots. Sentences are aligned by the words around a
filler; a place where the corpus shows several different fillers is an induced slot. A filler that is a variable's name in
some template syntax, a programming value for "nothing", a stand-in or a blank is residue if its place is such a slot. The
same string in a place that never varies ("close to null with this weave") is part of the text. Only places where some
filler is of those kinds can give a case, so the alignment of all others is left out: the test of the filler is put below
the join, which doesn't change the result.

Pages: error messages, notices about scripts and filler recur as whole pages. Sentences that keep company with each other
over all their documents are templates of a page; the lexicon only says which companies are meant. So a sentence about an
error within reviews isn't one. A line that recurs in texts of different languages belongs to none of them and counts
neither way. A document is a page if all its other sentences are; what isn't known is content, in whatever script.

All statistics cover all documents. What one task gathers is a sentence or place, counted by partial aggregation. Texts are
read once: tokens, places and sentences go on as 64-bit hashes.
"""

from __future__ import annotations

import html
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from weftline.runtime import materialize, release, spread

#: Forms of a variable in template languages, and of the error values of programs and sheets.
VARIABLE = (
    r"\{\{\{?[^{}\n]+\}?\}\}",
    r"<%=?[^%\n]+%>",
    r"\{%[^%{}\n]+%\}",
    r"[$#]\{[^{}\n]+\}",
    r"\{\$?[\w.-]*\}",
    r"%\([\w. -]+\)[sdif]",
    r"%\d\$[sdif]",
    r"(?<![\w%])%[sd](?!\w)",
    r"%[a-zA-Z_][\w.-]+%",
    r"@@[\w.-]+@@",
    r"~~[\w.-]+~~",
    r"(?<!\w)__?[a-zA-Z][\w.-]*?__?(?!\w)",
    r"<<[\w. -]+>>",
    r"<[a-zA-Z_][\w. -]+>",
    r"\[\[[\w. -]+\]\]",
    r"\[[\w. -]+\]",
    r"\$[a-zA-Z_][\w.-]*\$",
    r"#(?:REF|VALUE|NAME|NULL|NUM|N/A|DIV/0)[!?]?",
)

#: Programming values for "nothing", and stand-ins.
STAND_IN = (
    r"\(?\b(?:TBD|TBA|TODO|N/A|TK)\b\)?",
    r"\b(?:null|undefined|none|nan|nil|nonetype|void|xxx+)\b",
    r"(?<!\w)_{3,}(?!\w)",
    r"(?<!\w)\?{3,}(?!\w)",
)

#: Traces that a filler of nothing leaves: a blank before a comma or full stop, and empty brackets and quotes.
BLANK = (r"(?<=\p{L}) (?=[,.](?:\s|$))", r"\(\s*\)", r"“\s*”", r"«\s*»", r'(?<=\s)""(?=[\s,.])')

SUSPECT = regex.compile("|".join(VARIABLE) + "|" + "|".join(BLANK) + "|(?i:" + "|".join(STAND_IN) + ")")

#: Forms that occur nowhere but in templates: for these it is enough that the words on one side are followed (or led) by different words.
STRONG = regex.compile("|".join(v for v in VARIABLE if not v.startswith((r"\[[\w", r"(?<![\w%])%[sd]", r"<[a-z"))))

#: Cheap tests that every text and every sentence with a suspect passes, and few others.
SIGNS = ("{", "[", "<", "@@", "~~", "#", "__", "%", "$", "???", "null", "undef", "none", "nan", "nil", "void", "xxx", "tb", "todo", "n/a", "tk", " ,", " .", "( ", "()", "“", "«", '""')
MAYBE = re.compile(r"[{}\[\]<>@~#_]|%[\w(]|\$[a-zA-Z]|\?\?\?|null|undef|none|nan|nil|void|xxx|tb[da]|todo|n/a|tk| [,.](?:\s|$)|\(\s*\)|“\s*”|«\s*»|\"\"", re.I)

#: A place is a slot from this many different fillers. A place told by three words takes fillers of so many words; one told by
#: four, two on each side, takes fillers of any length within the sentence.
LEAST, SHORT = 3, 4

#: Least and greatest size, in powers of two, of the filter that keeps places no suspect stands in from being shuffled: 8 KB to 16 MB.
FILTER_BITS = (16, 27)

TOKEN = regex.compile(r"\d++(?:[.,]\d++)*+(?!\p{L})|[\p{L}\p{M}\d'’&-]+|[^\s\p{L}\d]")
INVISIBLE = regex.compile(r"(?![\n\t])[\p{Cf}\p{Cc}]")
BROKEN = re.compile(r"[ \t]*(?:\r\n|\n{3,})\s*")
BLANKS = re.compile(r"[^\S\n]+")
BULLET = re.compile(r"^[-*•\s]+")
OTHER_SCRIPT = regex.compile(r"(?<=[^\p{Latin}\p{Common}\p{Inherited}])(?:\s+|(?=\p{Latin}))(?=\p{Latin})|(?<=[\p{Latin}\p{N}\p{P}])\s+(?=[^\p{Latin}\p{Common}\p{Inherited}])|(?<=\p{Latin})(?=[^\p{Latin}\p{Common}\p{Inherited}])|\s+(?=[\uFF21-\uFF3A\uFF41-\uFF5A])")
FOREIGN = re.compile("[\u0370-\u1dff\u2c00-\ud7ff\uf900-\ufdff\ufe70-\uffef]")
RUN = re.compile(r"((\D)\2{9,})")
LETTERS_CODE = re.compile(r"\b[A-Z]{8}\b")
STOP = re.compile(r"[.!?:;…]$")
TAG = regex.compile(r"</?(?:p|br|div|span|b|i|em|strong|h[1-6]|ul|ol|li|a|html|body|head|title|noscript|script)\b[^<>]*>", regex.I)
SENTENCE = regex.compile(r"(?<=[.!?…])\s+(?=\S)|\n+")

#: Words of the customary filler text.
FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt "
    "culpa qui officia deserunt mollit anim id est laborum".split())

#: What sentences of error pages, notices and filler speak of, in the four languages of the corpus.
PAGE_PHRASES = (
    "javascript", "noscript", "skripte", "browser", "navigateur", "navegador", "roboter", "captcha", "are human", "être humain", "ein mensch",
    "es humano", "not found", "introuvable", "nicht gefunden", "no encontrado", "no encontrada", "server error", "erreur interne", "serverfehler",
    "error interno", "gateway", "service unavailable", "service indisponible", "nicht verfügbar", "servicio no disponible", "access denied",
    "accès refusé", "zugriff verweigert", "acceso denegado", "forbidden", "permission", "autorisation", "berechtigung", "permiso",
    "not authorised", "not authorized", "session expired", "session expirée", "sitzung abgelaufen", "sesión caducad", "log in again", "reconnect",
    "melden sie sich", "inicie sesión", "request limit", "try again", "erneut versuchen", "réessay", "reintentar", "something went wrong",
    "unexpected", "inattendue", "unerwartet", "inesperado", "exception", "maintenance", "wartung", "mantenimiento", "offline", "oops", "hoppla",
    "too many requests", "trop de requêtes", "zu viele anfragen", "demasiadas solicitudes", "could not be located", "could not be found",
    "link may be broken", "n'existe pas", "existiert nicht", "no existe", "has been removed", "placeholder", "text goes here", "dummy",
    "sample text", "sample paragraph", "coming soon", "lorem", "goes here", "ihr text", "votre texte", "su texto", "blindtext", "platzhalter",
    "texte d'exemple", "texto de ejemplo", "texto de relleno", "próximamente", "demnächst", "bientôt", "heading text", "button label", "loading",
    "chargement", "wird geladen", "cargando", "asdf", "qwerty")
#: The same as words of their own, with a sign that each needs.
PAGE_PATTERNS = re.compile(r"\bscripts?\b|\bcookies?\b|\brobots?\b|\bgone\b|\bups\b|\b(?:http|error|erreur|fehler|code|código)\s*[45]\d\d\b|^[45]\d\d\b")
PAGE_SIGNS = ("script", "cookie", "robot", "gone", "ups", "http", "error", "erreur", "fehler", "code", "código", "4", "5")

#: A sentence is a page template if on average at least this share of the sentences beside it are.
PAGE_SHARE = 0.35

#: A line is of no language if it stands in this many documents and no language has more than this share of them.
NO_LANGUAGE = (4, 0.7)

#: Most words of a name in front of a page.
NAME_WORDS = 6

# -- hashes: the same in Python, for single values, and in numpy, for whole batches -------------------------------------------

_MASK, _P1, _P2 = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_KINDS = {k: xxhash.xxh64_intdigest(k) for k in ("B", "C", "D", "X", "Y", "L", "R")}


def mix(a: int, b: int) -> int:
    x = ((a ^ (b * _P1 & _MASK)) * _P2) & _MASK
    return x ^ (x >> 29)


def mixed(kind: str, *parts: int) -> int:
    x = _KINDS[kind]
    for p in parts:
        x = mix(x, p)
    return x


def _mix_all(kind: str, *parts: np.ndarray) -> np.ndarray:
    x = np.full(len(parts[0]), _KINDS[kind], np.uint64)
    for p in parts:
        x = (x ^ (p * np.uint64(_P1))) * np.uint64(_P2)
        x = x ^ (x >> np.uint64(29))
    return x


class Hashes(dict):
    """Of each token met its hash, and what it counts as in a page: itself, "0" if it has a digit, or nothing if it is a sign.

    Bounded, so that no vocabulary is kept whole.
    """

    def __missing__(self, token: str) -> tuple[int, str | None]:
        if len(self) > 500_000:
            self.clear()
        word = ("0" if any(c.isdigit() for c in token) else token) if token[0].isalnum() else None
        self[token] = both = (xxhash.xxh64_intdigest(token), word)
        return both


START, END = xxhash.xxh64_intdigest("^"), xxhash.xxh64_intdigest("$")
FILLER_KEY, REPEATED_KEY = xxhash.xxh64_intdigest("filler text"), xxhash.xxh64_intdigest("a repeated word")


def plain(text: str) -> str:
    """Without entities, mark-up and invisible characters; runs of blanks are one."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = TAG.sub(" ", text.replace("<|endoftext|>", " "))
    if "\r" in text or "\n\n\n" in text:
        text = BROKEN.sub(" ", text)
    if not text.isprintable():
        text = INVISIBLE.sub("", text)
    return BLANKS.sub(" ", text.replace("#REF!", "#REF") if "#REF!" in text else text)


def sentences(text: str) -> list[str]:
    """Lines and sentences, without list marks. A long run of one sign, and words of another script, are sentences of their own."""
    parts = SENTENCE.split(text)
    if not text.isascii() and FOREIGN.search(text):
        parts = [x for p in parts for x in (OTHER_SCRIPT.split(p) if FOREIGN.search(p) else (p,))]
    if any(c * 10 in text for c in set(text)):
        parts = [x for p in parts for x in RUN.sub(r"\n\1\n", p).split("\n")]
    return [s for s in (BULLET.sub("", p).strip() for p in parts) if s]


def aligned(sentence: str) -> tuple[list[str], list[bool]]:
    """Words and single signs of a sentence in lower case, each suspect span as one token, and which tokens are suspect."""
    tokens, suspect, at = [], [], 0
    for m in SUSPECT.finditer(sentence):
        for t in TOKEN.findall(sentence[at : m.start()].lower()):
            tokens.append(t)
            suspect.append(False)
        tokens.append(regex.sub(r"\s+", "_", m.group().lower()))
        suspect.append(True)
        at = m.end()
    for t in TOKEN.findall(sentence[at:].lower()):
        tokens.append(t)
        suspect.append(False)
    return tokens, suspect


def places(h: list[int], i: int, j: int, strong: bool = False) -> list[tuple[int, int]]:
    """Place and hint of the filler ``h[i:j]`` of a sentence's hashes: two words before and one after, one before and two after, and two each.

    A place needs a word on the side of one, so that fillers at an end of the sentence are told by both of their neighbours.
    The hint is the pair of words a place starts or ends with, by which it is looked for.
    """
    l2, l1 = (h[i - 2] if i > 1 else START), (h[i - 1] if i > 0 else START)
    r1, r2 = (h[j] if j < len(h) else END), (h[j + 1] if j + 1 < len(h) else END)
    left, right, out = mixed("L", l2, l1), mixed("R", r1, r2), []
    if l1 != START and not (l2 == START and r1 == END):
        out.append((mixed("B", l2, l1, r1), left))
    if r1 != END and not (l1 == START and r2 == END):
        out.append((mixed("C", l1, r1, r2), right))
    if l1 != START and r1 != END:
        out.append((mixed("D", l2, l1, r1, r2), left))
    if strong and l2 != START:
        out.append((mixed("X", l2, l1), left))
    if strong and r2 != END:
        out.append((mixed("Y", r1, r2), right))
    return out


def suspects(suspect: list[bool]) -> Iterator[tuple[int, int]]:
    """Maximal runs of suspect tokens."""
    i = 0
    while i < len(suspect):
        if suspect[i]:
            j = i
            while j < len(suspect) and suspect[j]:
                j += 1
            yield i, j
            i = j
        else:
            i += 1


def _phrases():
    """A test for any phrase of the lexicon: an automaton where the library is there, else one phrase after the other."""
    try:
        import ahocorasick
    except ImportError:
        return lambda low: any(p in low for p in PAGE_PHRASES)
    automaton = ahocorasick.Automaton()
    for p in PAGE_PHRASES:
        automaton.add_word(p, True)
    automaton.make_automaton()
    return lambda low: next(automaton.iter(low), None) is not None


class Lexicon:
    """Whether a text in lower case has a word of the lexicon. Made anew in each worker, as the automaton doesn't travel."""

    def __init__(self):
        self.phrase = _phrases()

    def __call__(self, low: str) -> bool:
        return self.phrase(low) or any(p in low for p in PAGE_SIGNS) and PAGE_PATTERNS.search(low) is not None


def named(front: str) -> bool:
    """Whether a line may be the name of a store or product: short, in capitals or with one in front, and no sentence."""
    return len(front.split()) <= NAME_WORDS and front[:1].isupper() and not STOP.search(front)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def read(text: str, h: Hashes, speaks_of_pages) -> tuple[list[tuple[int, bool]], list[tuple[int, int]], array]:
    """A document's sentences (hash, and whether the lexicon has a word of it), the places of its suspects with hints, and its tokens.

    Numbers and codes count alike. Filler text of any length is one sentence, as are words repeated without sense. A name in
    front is no sentence. Tokens are hashes, two starts before and two ends after every sentence.
    """
    text = plain(text)
    parts = sentences(text)
    low = text.lower()
    seeded, odd = speaks_of_pages(low), any(s in low for s in SIGNS)
    stream, found, page = array("Q"), [], {}
    skip = 0
    if parts:
        front, dash, rest = parts[0].partition(" - ")
        if dash and rest and named(front):
            skip = 1 + len(TOKEN.findall(front)) + 1
        elif len(parts) > 1 and not dash and named(front) and not speaks_of_pages(front.lower()):
            skip = -1
    for at, s in enumerate(parts):
        if odd and MAYBE.search(s):
            tokens, suspect = aligned(s)
            both = [h[t] for t in tokens]
            hashes = [x for x, _ in both]
            for i, j in suspects(suspect):
                found += places(hashes, i, j, any(STRONG.fullmatch(t) for t in tokens[i:j]))
        else:
            tokens = TOKEN.findall(s.lower())
            both = [h[t] for t in tokens]
            hashes = [x for x, _ in both]
        stream.extend((START, START))
        stream.extend(hashes)
        stream.extend((END, END))
        if at == 0 and skip == -1:
            continue
        said = s
        if at == 0 and skip > 0:
            tokens, both, said = tokens[skip - 1 :], both[skip - 1 :], parts[0].partition(" - ")[2]
        words = [w for _, w in both if w]
        codes = {t.lower() for t in LETTERS_CODE.findall(said)} if not said.isupper() else ()
        if codes:
            words = ["0" if w in codes else w for w in words]
        letters = [w for w in words if w != "0"]
        if not words:
            words = [t[:1] for t in tokens[:1]]  # signs alone
        if len(letters) > 2 and sum(w in FILLER_WORDS for w in letters) >= 0.8 * len(letters):
            page[FILLER_KEY] = True
        elif len(letters) > 1 and len(set(letters)) == 1 and len(letters[0]) > 2 and letters[0].isascii():
            page[REPEATED_KEY] = True
        else:
            if len(words) == 1 and len(words[0]) > 9 and len(set(words[0])) == 1:
                words = [words[0][0] * 10]  # a run of one letter, whatever its length
            key = xxhash.xxh64_intdigest(" ".join(words))
            page[key] = page.get(key, False) or seeded and speaks_of_pages(said.lower())
    return list(page.items()), found, stream


SCAN = "doc bigint, lang string, key bigint, hint bigint, seed boolean, tokens array<bigint>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of three kinds: a sentence (key, seed), a suspect's place (key, hint), and a document's tokens."""
    h, lexicon = Hashes(), Lexicon()
    for batch in batches:
        docs: list = []
        langs: list = []
        keys: list = []
        hints: list = []
        seeds: list = []
        tokens: list = []
        for doc, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if not text or not text.strip():
                continue
            page, found, stream = read(text, h, lexicon)
            n = len(page) + len(found) + 1
            docs += [doc] * n
            langs += [lang] * n
            keys += [_signed(k) for k, _ in page] + [_signed(k) for k, _ in found] + [None]
            hints += [None] * len(page) + [_signed(x) for _, x in found] + [None]
            seeds += [x for _, x in page] + [None] * (len(found) + 1)
            tokens += [None] * (n - 1) + [np.frombuffer(stream, np.int64) if stream else np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(hints, pa.int64()), pa.array(seeds, pa.bool_()), pa.array(tokens, pa.list_(pa.int64()))],
            names=["doc", "lang", "key", "hint", "seed", "tokens"])


def fillers_at(tokens: np.ndarray, known) -> set[tuple[int, int]]:
    """Place and filler (hashes) wherever ``known`` (an array of hashes to an array of truths) has the place. Fillers end with their sentence."""
    out: set[tuple[int, int]] = set()
    if len(tokens) < 4:
        return out
    a, b = tokens[:-1], tokens[1:]

    def add(spots: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        hit = known(spots)
        for place, i, j in zip(spots[hit].tolist(), start[hit].tolist(), stop[hit].tolist()):
            out.add((place, int(tokens[i]) if j - i == 1 else xxhash.xxh64_intdigest(tokens[i:j].tobytes())))

    # Fillers that follow a known pair of words: the one word after it, up to SHORT words before a third word, or any before a third and fourth.
    at = np.flatnonzero(known(_mix_all("L", a, b)) & (a != END) & (b != END))
    if len(at):
        ends = np.flatnonzero(tokens == END)
        end = ends[np.searchsorted(ends, at + 2)]  # the first end mark of the sentence
        k = 1
        while True:
            left = at + 2 + k <= end
            at, end = at[left], end[left]
            if not len(at):
                break
            if k == 1:
                add(_mix_all("X", tokens[at], tokens[at + 1]), at + 2, at + 3)
            if k <= SHORT:
                add(_mix_all("B", tokens[at], tokens[at + 1], tokens[at + 2 + k]), at + 2, at + 2 + k)
            add(_mix_all("D", tokens[at], tokens[at + 1], tokens[at + 2 + k], tokens[at + 3 + k]), at + 2, at + 2 + k)
            k += 1
    # Fillers that come before a known pair.
    at = np.flatnonzero(known(_mix_all("R", a, b)) & (a != START) & (b != START))
    if len(at):
        starts = np.flatnonzero(tokens == START)
        start = starts[np.maximum(np.searchsorted(starts, at) - 1, 0)]  # the last start mark of the sentence
        for k in range(1, SHORT + 1):
            left = (at - k > start) & (start < at)
            at, start = at[left], start[left]
            if not len(at):
                break
            if k == 1:
                add(_mix_all("Y", tokens[at], tokens[at + 1]), at - 1, at)
            add(_mix_all("C", tokens[at - 1 - k], tokens[at], tokens[at + 1]), at - k, at)
    return out


def _fillers(bits: bytes, power: int):
    """A task over tokens that gives place and filler wherever the filter knows the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, mask = np.frombuffer(bits, np.uint8), np.uint64((1 << power) - 1)

        def known(x: np.ndarray) -> np.ndarray:
            at = x & mask
            return (field[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

        for batch in batches:
            tokens = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
            found = fillers_at(tokens, known)
            keys, spans = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([_signed(k) for k in keys], pa.int64()), pa.array([_signed(x) for x in spans], pa.int64())], names=["key", "filler"])

    return run


def filter_of(keys: DataFrame) -> tuple[bytes, int]:
    """A bit field that knows the hashes in ``key``, and its size as a power of two, by their number. At most 16 MB come to the driver."""
    n = keys.count()
    power = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * n).bit_length()))
    chunks = keys.groupBy(F.expr(f"bitmap_bucket_number((key & {(1 << power) - 1}L) + 1)").alias("chunk")).agg(
        F.expr(f"bitmap_construct_agg(bitmap_bit_position((key & {(1 << power) - 1}L) + 1))").alias("bits")).collect()
    field, size = bytearray((1 << power) // 8), 4096
    for c in chunks:
        field[(c["chunk"] - 1) * size : c["chunk"] * size] = c["bits"]
    return bytes(field), power


def slot_documents(scanned: DataFrame, least: int = LEAST) -> DataFrame:
    """Ids of the documents with residue in an induced slot.

    A filter sized by their number holds the places of all suspects and the hints to them; places it may know come from all
    texts with their fillers, and the exact join afterwards leaves no trace of its false positives.
    """
    marked = scanned.filter(F.col("hint").isNotNull()).select("doc", "key", "hint").distinct()
    bits, power = filter_of(marked.select("key").unionByName(marked.select(F.col("hint").alias("key"))).distinct())
    fillers = scanned.filter(F.col("tokens").isNotNull()).select("tokens").mapInArrow(_fillers(bits, power), "key bigint, filler bigint")
    slots = fillers.distinct().groupBy("key").agg(F.count("*").alias("fillers")).filter(F.col("fillers") >= least)
    return marked.join(slots, "key", "left_semi").select("doc").distinct()


def page_documents(scanned: DataFrame, share: float = PAGE_SHARE, rounds: int = 3) -> DataFrame:
    """Ids of the documents that consist of page templates.

    Each round asks of every sentence what company it keeps: the mean share, over its documents, of the other sentences
    that are page templates so far (in the first round: that the lexicon suspects). A suspected sentence that makes a
    document alone is its own company; one not suspected needs others, in two documents. Lines of no language are left out
    of all this, unless the lexicon suspects them; a document of such lines alone is no page.
    """
    rows = scanned.filter(F.col("seed").isNotNull()).select("doc", "lang", "key", "seed")
    by_lang = rows.groupBy("key", "lang").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    docs, most = NO_LANGUAGE
    stray = by_lang.groupBy("key").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max("seed").alias("seed")).filter(
        ~F.col("seed") & (F.col("all") >= docs) & (F.col("most") <= most * F.col("all"))).select("key")
    rows = rows.drop("lang").join(stray, "key", "left_anti")
    sizes = rows.groupBy("doc").agg(F.count("*").cast("int").alias("n"), F.count_if("seed").cast("int").alias("n_page"))
    rows = materialize(rows.join(sizes, "doc").withColumn("page", F.col("seed")), "pages")
    for _ in range(rounds):
        others = F.when(F.col("n") > 1, (F.col("n_page") - F.col("page").cast("int")) / (F.col("n") - 1)).when(F.col("seed"), 1.0)
        asked = rows.groupBy("key").agg(F.avg(others).alias("company"), F.count(others).alias("docs"), F.max("seed").alias("seed"))
        templates = asked.filter((F.col("company") >= share) & (F.col("seed") | (F.col("docs") > 1))).select("key", F.lit(True).alias("is_page"))
        joined = rows.join(templates, "key", "left").withColumn("page", F.coalesce("is_page", F.lit(False))).drop("is_page", "n_page")
        counted = joined.groupBy("doc").agg(F.count_if("page").cast("int").alias("n_page"))
        following = materialize(joined.join(counted, "doc"), "pages")
        release(rows)
        rows = following
    return rows.filter(F.col("n_page") == F.col("n")).select("doc").distinct()


def find_residue(documents: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, kind`` of the documents that are residue: ``slot`` or ``page``, one row each (``page`` where both).

    Defined results: null, empty and blank texts are no cases; repeated rows of a document give one; texts of any length and
    script are read whole; an empty table gives an empty one; without a ``lang`` column no line counts as stray, and null
    languages are one language; other columns aren't read. A place needs ``LEAST`` different fillers, so a corpus too small to
    show a template gives no slots.
    """
    language = F.col(lang) if lang in documents.columns else F.lit(None).cast("string")
    texts = spread(documents.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"), language.alias("lang")))
    scanned = materialize(texts.mapInArrow(_scan, SCAN), "scanned")
    pages = page_documents(scanned).withColumn("kind", F.lit("page"))
    slots = slot_documents(scanned).withColumn("kind", F.lit("slot"))
    return pages.unionByName(slots).groupBy("doc").agg(F.min("kind").alias("kind")).withColumnRenamed("doc", doc)


def without_residue(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are no residue, as they came."""
    return documents.join(find_residue(documents, doc, text).select(doc), doc, "left_anti")
