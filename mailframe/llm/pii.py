"""Personal data in texts, disguised or not, as spans of the source text.

Plain detection finds e-mail addresses, IP addresses, card numbers and phone numbers, leftmost and
non-overlapping per kind; matches that fail their test are dropped without a second try.

Deobfuscation. A text with a word or mark that a disguise needs (``at``, ``dot``, bracketed forms, spelled digits,
letters or digits of another script that look Latin) passes a transducer as a whole. It reads the
source left to right and writes normal characters: look-alike letters and digits become ASCII, invisible
characters vanish, "(at)" becomes "@", " dot " becomes ".", "five" becomes "5". What it copies and what it writes it keeps as
runs with their places in the source. Detectors run on what is written, and a match is mapped back: it starts
where its first character's source starts and ends where its last one's source ends. A span is added if a
character in it was written by a rule and it overlaps no plain span of its kind but those that are part of it. Nothing
bounds an identifier's length, and all steps are linear but for the logarithm of a search in sorted runs.

A plain ``at`` counts before a host with a disguised dot ("name at mail.host dot org"). Before a host with real dots only it
counts after a name that no word looks like, with a digit or mark in it ("jane.doe at host.org"), or one that a word for
mail stands before ("mail jane at host.org"): "look at host.org" stays clean. A plain ``dot`` counts beside any word or digit;
what it makes must pass a detector. Digits are read as a run of spelled and written ones if three are spelled, of five in all, dots
said between them or not, or if four have dots between all.

Null texts are empty texts: no spans. Repeated rows give repeated results. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The part before @ is the run of its characters that ends there and starts after the last match.

    Looking from each @ keeps long runs without one linear; the matches are those of a scan from the left.
    """
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            out.append((a, m.end()))
            last = m.end()
    return out


def plain(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of plain personal data, by start, then kind as listed."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(q) < 4 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in m[0].split("."))):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((*m.span(), 3))
    out.sort(key=lambda x: (x[0], x[2]))
    return [(a, b, KINDS[k]) for a, b, k in out]


# Look-alikes of ASCII letters, digits and marks, and the spelled digits of four languages.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅαονρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTXIJSaovptuxABEZHIKMNOPTYX", strict=True))
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_INVISIBLE = "­​‌‍⁠﻿"
_FULL_WIDTH = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
#: One character for one; invisible ones vanish.
_CHARACTERS = LOOK_ALIKES | _FULL_WIDTH | dict.fromkeys(_INVISIBLE, "") | {"․": ".", "。": "."}
_STRANGE = "[" + "".join(map(re.escape, _CHARACTERS)) + "]"
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
#: White space before a bracket is tried from its start only, so that long runs of it stay linear.
_OPEN = r"(?:(?<!\s)\s+|)[\[({<]\s*"
_CLOSED = rf"{_OPEN}(?:dot|\.)\s*[\])}}>]\s*"
_SAID = r"(?<=[\w-])\s+dot\s+(?=[\w-])"
#: A host's labels up to its first disguised dot; real ones may stand before it.
_HOST = rf"[\w-]+(?:[.․。．][\w-]+)*(?:\s+dot\s+|{_CLOSED})"
#: Between spelled digits; a dot is written where one was said.
_DOTS = rf"(?:{_CLOSED}|\s+dot\s+|[.])"
_GAP = rf"(?:{_DOTS}|[\s-]+)"
#: A digit, spelled or written.
_DIGIT = rf"(?:{_WORD}|[0-9]+)"
_OPEN_AT = rf"{_OPEN}(?:at|@)\s*[\])}}>]\s*"
_REAL_HOST = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_RULES = re.compile(
    rf"(?P<at>{_OPEN_AT}|(?<=[\w.%+-])\s+at\s+(?={_HOST}[\w-]))"
    rf"|(?P<maybe>(?<=[\w.%+-])\s+at\s+(?={_REAL_HOST}))"
    rf"|(?P<digits>(?<!\w){_DIGIT}(?:(?:{_GAP}{_DIGIT}){{4,}}|(?:{_DOTS}{_DIGIT}){{3}})(?!\w))"
    rf"|(?P<dot>{_CLOSED}|{_SAID})"
    rf"|(?P<one>{_STRANGE})",
    re.IGNORECASE,
)
# Cheap marks of a disguise, one for each rule that can fire; a text without one passes no transducer.
_BRACKETS = re.compile(r"[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]", re.IGNORECASE)
_LOOKS = re.compile(_STRANGE, re.IGNORECASE)
_AT_ALL = re.compile(r"\sat\s", re.IGNORECASE)
_AT = re.compile(rf"(?<=[\w.%+-])\s+at\s+(?:{_HOST}[\w-]|{_REAL_HOST})", re.IGNORECASE)
_DOT = re.compile(_SAID, re.IGNORECASE)
_SPELLED_TWICE = re.compile(rf"(?<!\w)(?:{_WORD}){_GAP}(?:[0-9]+{_GAP})*(?:{_WORD})(?!\w)")
_DIGIT_OR_DOT = re.compile(rf"(?P<spelled>{_WORD})|(?P<written>[0-9]+)|(?P<dot>{_CLOSED}|\s+dot\s+)|(?P<point>[.])", re.IGNORECASE)
_SAID_DOT = re.compile(rf"{_CLOSED}|\s+dot\s+", re.IGNORECASE)
# Words for mail that may stand before a name, and words that are no name after them.
_CUES = frozenset("email emails mail mails mailto contact kontakt correo courriel write reach address".split())
_NO_NAME = frozenset("us me you him her them it here there now today back directly is are was be and or to the a".split())


def _marked(text: str) -> bool:
    """Whether a rule may fire in the text."""
    if not text.isascii() and _LOOKS.search(text):
        return True
    if _BRACKETS.search(text) or (_AT_ALL.search(text) and _AT.search(text)):
        return True
    low = text.lower().replace("ſ", "s").replace("i\u0307", "i")
    if "dot" in low and _DOT.search(low):
        return True
    # of three spelled digits in a run, the second stands between white space, hyphens and dots
    return not SPELLED.keys().isdisjoint(low.replace("-", " ").replace(".", " ").split()) and bool(_SPELLED_TWICE.search(low))


def _spelled(word: str) -> str:
    """The digit of a spelled one, with the letters that compare equal to s and i without case."""
    return SPELLED.get(word.lower().replace("ſ", "s").replace("i\u0307", "i"), "")


def _named(text: str, end: int) -> bool:
    """Whether what ends there, before a plain at and a real host, is a mailbox's name."""
    a = end
    while a > 0 and text[a - 1] in _LOCAL:
        a -= 1
    name = text[a:end]
    if not name.isalpha():
        return any(c.isalpha() for c in name) and name[-1] not in ".-"
    return name.lower() not in _NO_NAME and _cued(text, a)


def _cued(text: str, end: int) -> bool:
    """Whether a word for mail stands before what starts there, with "to" or "is" and one mark between or not, and any white space."""

    def blank(at: int) -> int:
        while at > 0 and text[at - 1].isspace():
            at -= 1
        return at

    def word(at: int) -> int:
        while at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_"):
            at -= 1
        return at

    at = blank(end)
    if at > 0 and text[at - 1] in ":<(":
        at = blank(at - 1)
    start = word(at)
    if text[start:at].lower() in ("to", "is") and (before := blank(start)) < start:
        start, at = word(before), before
    return text[start:at].lower().replace("\u017f", "s") in _CUES


class Transducer:
    """Writes a normal form of a text and keeps its runs: where each starts in the normal form, its source, and whether a rule wrote it."""

    def __init__(self, text: str) -> None:
        self._written: list[str] = []
        self._size = 0
        self.at, self.starts, self.ends, self.rules = [], [], [], []
        done = 0
        for m in _RULES.finditer(text):
            if m["maybe"] and not _named(text, m.start()):
                continue
            self._copy(text, done, m.start())
            done = m.end()
            if m["one"]:
                self._write(_CHARACTERS.get(m[0], m[0]), m.start(), done)
            elif m["digits"]:
                self._digits(text, *m.span())
            else:
                self._write("." if m["dot"] else "@", m.start(), done)
        self._copy(text, done, len(text))
        self.text = "".join(self._written)

    def _digits(self, text: str, a: int, b: int) -> None:
        found = list(_DIGIT_OR_DOT.finditer(text, a, b))
        if sum(1 for d in found if d["spelled"]) >= 3 or sum(1 for d in found if d["dot"]) >= 3:
            for d in found:
                if d["written"] or d["point"]:
                    self._copy(text, *d.span())
                else:
                    self._write(_spelled(d[0]) if d["spelled"] else ".", *d.span())
            return
        for d in _SAID_DOT.finditer(text, a, b):
            self._copy(text, a, d.start())
            self._write(".", *d.span())
            a = d.end()
        self._copy(text, a, b)

    def _run(self, written: str, a: int, b: int) -> None:
        self._written.append(written)
        self.at.append(self._size)
        self.starts.append(a)
        self.ends.append(b)
        self._size += len(written)

    def _copy(self, text: str, a: int, b: int) -> None:
        if a < b:
            self._run(text[a:b], a, b)

    def _write(self, c: str, a: int, b: int) -> None:
        if c:
            self.rules.append(self._size)
            self._run(c, a, b)

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source of the normal form's characters a to b."""
        out = []
        for place, edge in ((a, 0), (b - 1, 1)):
            i = bisect_right(self.at, place) - 1
            j = bisect_left(self.rules, self.at[i])
            by_rule = j < len(self.rules) and self.rules[j] == self.at[i]
            out.append((self.ends if edge else self.starts)[i] if by_rule else self.starts[i] + place - self.at[i] + edge)
        return out[0], out[1]

    def disguised(self, a: int, b: int) -> bool:
        j = bisect_left(self.rules, a)
        p, q = self.source(a, b)
        return (j < len(self.rules) and self.rules[j] < b) or q - p != b - a


class _Taken:
    """Spans of one kind that don't overlap, in order: which of them a span meets."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def over(self, a: int, b: int) -> list[tuple[int, int]]:
        i, j = bisect_right(self.ends, a), bisect_left(self.starts, b)
        return list(zip(self.starts[i:j], self.ends[i:j], strict=True))

    def add(self, a: int, b: int) -> None:
        self.starts.append(a)
        self.ends.append(b)


def disguised(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of disguised personal data that overlap no known span of their kind, unless they hold it and more."""
    if not _marked(text):
        return []
    t, out = Transducer(text), []
    there = {k: _Taken([(a, b) for a, b, kind in known if kind == k]) for k in KINDS}
    added = {k: _Taken([]) for k in KINDS}
    for x, y, kind in plain(t.text):
        if not t.disguised(x, y):
            continue
        p, q = t.source(x, y)
        # a known span may be the plain part of this one; any other overlap leaves the known one alone
        if all(p <= c and d <= q and d - c < q - p for c, d in there[kind].over(p, q)) and not added[kind].over(p, q):
            added[kind].add(p, q)
            out.append((p, q, kind))
    return out


def spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(plain spans, all spans), by start, then kind as listed; code points, end exclusive."""
    base = plain(text or "")
    more = disguised(text, base) if text else []
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]))) if more else base


def _line(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def redact(text: str | None, mark: str = "[{}]") -> str | None:
    """text with every span, disguised or not, replaced by its kind; overlapping spans are replaced together."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans(text)[1]:
        if a >= at:
            out += [text[at:a], mark.format(kind)]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of df's: doc_id, plain spans counted by kind and as a digest, all spans as text, and how many were added."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                base, every = spans(t.as_py())
                own = [x[2] for x in base]
                rows.append((i, *(own.count(k) for k in KINDS), hashlib.sha256(_line(base).encode()).hexdigest(), _line(every), len(every) - len(base)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(each, schema)
