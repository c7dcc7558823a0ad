"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text as it stands. Then a chain of transducers rewrites disguises:
invisible characters go, homoglyphs and digits of other scripts become ASCII, spelled digits become
digits, and at/dot disguises become '@' and '.'. Each rewritten character remembers the source
characters it stands for, so what is found in the rewritten text is mapped back to source spans.
Those spans are added to the plain ones, which always stay.

All scans take time in proportion to the text, whatever it holds: patterns enter a run of digits or
letters at its start only, and addresses are read outwards from their signs.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Runs of digits are entered at their start only: no match begins within one.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Spelled digits in the languages of the corpus, invisible characters and letters of
# other scripts that look like Latin ones.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
LOOKALIKE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "\u0131": "i", "\u0251": "a", "\u0261": "g", "\u2024": ".", "\u3002": ".", "\u2022": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\ufe63": "-", "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u3000": " ",
}


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _byte(digits: str) -> bool:
    """Whether a run of digits, however long, is at most 255."""
    short = digits.lstrip("0")
    return len(short) < 3 or len(short) == 3 and short <= "255"


def _numbers(text: str) -> list[tuple[int, int, int]]:
    """Plain addresses of machines, cards and phone numbers."""
    found = []
    for m in IP.finditer(text):
        if all(map(_byte, m.group().split("."))):
            found.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), m.end(), 3))
    return found


def _emails(text: str) -> list[tuple[int, int, int]]:
    """From each '@' the local part reaches left to the first other character or the last match."""
    found = []
    free, at = 0, text.find("@")
    while at >= 0:
        if at > free:
            part = text[free:at]
            size = at - free - len(part.rstrip(LOCAL))
            m = size and DOMAIN.match(text, at + 1)
            if m:
                found.append((at - size, m.end(), 0))
                free = m.end()
        free = max(free, at + 1)
        at = text.find("@", free)
    return found


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of identifiers as they stand, by start, then kind. Matches that fail their
    check are dropped; the search goes on behind them."""
    return sorted(_emails(text) + _numbers(text), key=lambda s: (s[0], s[2]))


class Mapped:
    """A text whose characters each stand for a span of the source."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = np.arange(len(text), dtype=np.int32)
        self.ends = self.starts + 1
        #: Zero for a character of the source, else what has been made of it.
        self.made = np.zeros(len(text), np.int8)

    def rewrite(self, pattern: re.Pattern, target) -> Mapped:
        """Replaces matches by what target(match) gives: (text, made). A replacement's characters all
        stand for the whole match."""
        text: list[str] = []
        starts, ends, made = [], [], []
        at = 0

        def keep(a: int, b: int) -> None:
            text.append(self.text[a:b])
            starts.append(self.starts[a:b])
            ends.append(self.ends[a:b])
            made.append(self.made[a:b])

        for m in pattern.finditer(self.text):
            new, what = target(m)
            keep(at, m.start())
            text.append(new)
            starts.append(np.full(len(new), self.starts[m.start()]))
            ends.append(np.full(len(new), self.ends[m.end() - 1]))
            made.append(np.full(len(new), what, np.int8))
            at = m.end()
        if not at:
            return self
        keep(at, len(self.text))
        out = Mapped("")
        out.text, out.starts, out.ends, out.made = "".join(text), np.concatenate(starts), np.concatenate(ends), np.concatenate(made)
        return out

    def translated(self) -> Mapped:
        """Look-alikes become what they stand for, invisible characters go."""
        codes = np.frombuffer(self.text.encode("utf-32-le"), "<u4")
        values, inverse = np.unique(codes, return_inverse=True)
        new = np.array([_stands_for(chr(c)) for c in values], np.uint32)[inverse]
        stay = new != GONE
        out = Mapped("")
        out.text = new[stay].astype("<u4").tobytes().decode("utf-32-le")
        out.starts, out.ends, out.made = self.starts[stay], self.ends[stay], (new != codes)[stay].astype(np.int8) * OTHER
        return out

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def stands(self, start: int, end: int) -> bool:
        """Whether a span stands in the source as it is."""
        return not self.made[start:end].any() and int(self.ends[end - 1] - self.starts[start]) == end - start


def _ascii_of(c: str) -> str | None:
    """What a look-alike stands for; None for a character that is not one."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    if c.isdigit() and unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and wide.isascii() and wide.isprintable() else None


#: Stands for no character in an array of code points.
GONE = 0xFFFFFFFF


def _stands_for(c: str) -> int:
    new = _ascii_of(c) if STRANGE.match(c) else None
    return ord(c) if new is None else ord(new) if new else GONE


#: Characters that can be look-alikes at all: not the accented letters of European languages.
STRANGE = re.compile("[ ­ıɑɡ͏Ͱ-ϿЀ-ԯ؜٠-٩۰-۹߀-߉०-෿๐-๙၀-၉᠎ -⁯①-⒛　-。︀-﹯﻿-￯\U0001d400-\U0001d7ff]")
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_POINT = "dot|point|punkt|punto"
_DIGIT = rf"(?:(?<![^\W_])(?:{_WORD})(?![^\W_])|[0-9])"
#: Four or more digits in a row, the first one spelled; a word "plus" may lead.
SPOKEN = re.compile(rf"(?:(?<![^\W_])plus[\s-]{{1,2}})?(?<![^\W_])(?:{_WORD})(?![^\W_])(?:[\s,-]{{1,2}}(?:(?<![^\W_])(?:{_POINT})(?![^\W_])[\s,-]{{1,2}})?{_DIGIT}){{3,}}(?![^\W_])", re.I)
POINTS = frozenset(_POINT.split("|"))
_PART = re.compile(rf"(?<![^\W_])(?:{_WORD}|plus|{_POINT})(?![^\W_])|[0-9]", re.I)
#: Signs of an address: marked or dashed ones, and bare words or spaced signs, which need more proof.
_DASHED_AT, _MARKED_AT = r"[-_*~]at[-_*~]", r"(?:[\[({<]\s{0,2}(?:at|@|arroba|ät)\s{0,2}[\])}>]|&#(?:64|x40);)"
_AT = rf"(?:[-_*~]?{_DASHED_AT}[-_*~]?|\s{{0,2}}{_MARKED_AT}\s{{0,2}})"
_BARE_AT = r"\s{1,2}(?:at|arroba)\s{1,2}|\s{1,2}@\s{0,2}|\s{0,2}@\s{1,2}"
_SPACED_DOT, _DASHED_DOT, _MARKED_DOT = r"\s(?:dot|punkt|punto)\s", r"[-_*~]dot[-_*~]", r"(?:[\[({<]\s{0,2}(?:dot|\.|punkt|punto|point)\s{0,2}[\])}>]|&#(?:46|x2e);)"
_DOT = rf"(?:[-_*~]?{_DASHED_DOT}[-_*~]?|\s{{0,2}}{_MARKED_DOT}\s{{0,2}}|\s?{_SPACED_DOT}\s?)"
# Last labels that make words around a bare "at" an address.
TOP = frozenset((
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "dev", "app", "io", "ai", "co", "me", "tv", "us", "uk", "ca", "au", "de", "fr", "es", "it", "nl",
    "eu", "ch", "at", "be", "pl", "se", "no", "dk", "fi", "pt", "ie", "in", "cn", "jp", "kr", "ru", "br", "mx", "ar", "cl", "test", "example",
))
DIGIT_DOT = re.compile(rf"(?<=[0-9]){_DOT}(?=[0-9])", re.I)
SIGNS = re.compile(rf"({_DOT})|({_AT})|(?:{_BARE_AT})", re.I)
#: What a character has been made of: a look-alike or spelled digit, a dot, a sure at, a bare at.
OTHER, DOT, AT, BARE = 1, 2, 3, 4


def _starting(words) -> str:
    """An alternation by first letters, which a search can skip to; words begin and end at a boundary."""
    by: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(rf"{c}(?<![^\W_]{c})(?:{'|'.join(rest)})(?![^\W_])" for c, rest in sorted(by.items()))


#: What must be in a lower-cased text for a transducer to find anything: a spelled digit before
#: another or a digit, a dot or an at in disguise. Each lets more pass than its transducer takes.
HAS_SPOKEN = re.compile(rf"(?:{_starting(SPELLED)})[\s,-]{{1,2}}(?:[0-9]|{_starting(list(SPELLED) + list(POINTS))})")
MARKED = re.compile(r"[\[({<]\s{0,2}(?:at|@|arroba|ät|dot|\.|punkt|punto|point)\s{0,2}[\])}>]")
ENTITY = re.compile(r"&#(?:64|x40|46|x2e);")
DASHED = re.compile(r"[-_*~](?:at|dot)[-_*~]")
SPACED = re.compile(r"\s(?:dot|punkt|punto)\s")


def has_sign(low: str) -> bool:
    if DASHED.search(low) or MARKED.search(low) or "&#" in low and ENTITY.search(low):
        return True
    return ("dot" in low or "punkt" in low or "punto" in low) and SPACED.search(low) is not None


def disguised(text: str) -> bool:
    """Whether any transducer could change the text."""
    plain_ascii = text.isascii()
    low = text.lower() if plain_ascii else text.casefold()
    return bool(not plain_ascii and STRANGE.search(text) or has_sign(low) or HAS_SPOKEN.search(low))


def _spoken(m: re.Match) -> tuple[str, int]:
    parts = [p.lower() for p in _PART.findall(m.group())]
    return "".join("+" if p == "plus" else "." if p in POINTS else SPELLED.get(p, p) for p in parts), OTHER


def _sign(m: re.Match) -> tuple[str, int]:
    return (".", DOT) if m.group(1) else ("@", AT if m.group(2) else BARE)


def normalised(text: str) -> Mapped:
    """The text without homoglyphs, spelled digits and disguised dots between digits."""
    mapped = Mapped(text)
    if not text.isascii():
        mapped = mapped.translated()
    mapped = mapped.rewrite(SPOKEN, _spoken)
    return mapped.rewrite(DIGIT_DOT, lambda m: (".", DOT))


def addresses(signed: Mapped) -> list[tuple[int, int, int]]:
    """Addresses of a text whose signs of addresses have all been rewritten, whether they are of one or not.

    Each '@' is read outwards. A sure one takes whatever looks like an address around it. One that
    stood as it is takes plain dots, and disguised ones where a known last label follows them; a bare
    one needs both."""
    text, made = signed.text, signed.made
    found = []
    free, at = 0, text.find("@")
    while at >= 0:
        part = text[free:at]
        begin = free + len(part.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if begin < at else None
        end = 0
        if m:
            end = m.end()
            hidden = np.flatnonzero(made[at + 1 : end] == DOT)
            if made[at] != AT and len(hidden):
                end = _known_end(text, at + 1, end, at + 1 + int(hidden[0]))
                hidden = hidden[hidden < end - at - 1]
            if made[at] == BARE and not len(hidden):
                end = 0
            if made[at] not in (AT, BARE) and not len(hidden):  # what leads by a disguised dot is no part of it
                dots = np.flatnonzero(made[begin:at] == DOT)
                begin += int(dots[-1]) + 1 if len(dots) else 0
            while begin < at and made[begin] == DOT:
                begin += 1
        if end and begin < at:
            found.append((begin, end, 0))
        free = max(end, at + 1)
        at = text.find("@", free)
    return found


def _known_end(text: str, start: int, end: int, hidden: int) -> int:
    """Where a domain ends: behind its last known last label that follows the first disguised dot,
    else before that dot if a plain one stands before it (zero: nowhere)."""
    while True:
        dot = text.rfind(".", start, end)
        if dot < hidden:
            return hidden if "." in text[start:hidden] else 0
        if text[dot + 1 : end].lower() in TOP:
            return end
        end = dot


def detect(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(plain spans, all spans), each (start, end, kind) by start, then kind. A disguised span within
    a plain one of its kind is not added."""
    base = plain(text)
    if not disguised(text):
        return base, base
    mapped = normalised(text)
    signed = mapped.rewrite(SIGNS, _sign)
    added = set()
    held = [[s for s in base if s[2] == kind] for kind in range(len(KINDS))]
    for view, spans in ((mapped, _numbers(mapped.text)), (signed, addresses(signed))):
        for start, end, kind in spans:
            if view.stands(start, end):
                continue
            a, b = view.source(start, end)
            before = bisect.bisect_right(held[kind], a, key=lambda s: s[0])
            if not before or held[kind][before - 1][1] < b:
                added.add((a, b, kind))
    return base, sorted({*base, *added}, key=lambda s: (s[0], s[2], s[1]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by its first kind, such as [EMAIL]."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), a row for
    each row.

    Counts and base_sha256 are those of the plain spans, spans holds all of them, n_added how many
    the transducers add. Offsets are code points, the end exclusive. A null text counts as empty; texts
    and runs of digits may be of any length; ids and rows may be null or repeat; an empty table gives an empty result; further columns are ignored.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                base, spans = detect(text)
                counts = [0, 0, 0, 0]
                for _, _, kind in base:
                    counts[kind] += 1
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def redacted(docs: DataFrame, column: str = "text") -> DataFrame:
    """documents with every span of personal data in a text column replaced; null texts stay null and
    all other columns pass as they are."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts = batch.column(at).to_pylist()
            clean = [t and redact(t, detect(t)[1]) for t in texts]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(clean, pa.string()))

    return docs.mapInArrow(run, docs.schema)
