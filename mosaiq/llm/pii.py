"""Personal data, also where it is disguised, with spans in the source text.

The base finds plain identifiers. For disguises three transducers rewrite the text while an
offset map keeps, for every character they write, the source characters it came from:

* homoglyphs: look-alike letters (full-width, mathematical, Cyrillic, Greek; O and l among digits),
  digits of other scripts, odd dots and at-signs become ASCII; zero-width characters and soft hyphens vanish;
* spelled digits: runs of at least three number words become digits, their separators vanish;
  single characters set apart by single blanks close up if they make an address or an IP;
* at/dot disguises: "[at]", "(dot)", "{.}", "&#64;", spaced "at" and "dot" words between host
  labels become "@" and ".". Blanks around them, labels and their number may be of any length.

All of them take time linear in the text: patterns repeat possessively, and the scans to the left
and right of a sign never pass the end of the address before.

The base patterns run over the rewritten text; what they find there and that touches a rewritten
character is mapped back to source offsets. Such a span is added unless it overlaps a base span
of its kind that it does not merely complete by disguised letters; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .common import id_text, process_cache

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start, end of the plain identifiers, by start and then kind."""
    out = []
    at = text.find("@")
    free = 0  # end of the last e-mail match
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37:  # 19 digits and 18 separators at most
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- transducers ---------------------------------------------------------------------------

#: Letters of other alphabets that look like Latin ones.
_CYRILLIC_GREEK = dict(zip("АВЕЅІЈКМНОРСТУХаеіјорсухѕԁɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧοντ", "ABESIJKMHOPCTYXaeijopcyxsdgABEZHIKMNOPTYXovt", strict=True))
#: Signs that stand for the at-sign, the dot, the plus and the hyphen.
_SIGNS = {
    "﹫": "@", "。": ".", "\u2024": ".", "\u2027": ".", "∙": ".", "·": ".", "﹒": ".",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "–": "-", "\u2212": "-", "﹢": "+",
    "\u00A0": " ", "\u202F": " ", "\u2007": " ", "\u3000": " ",
}
_INVISIBLE = frozenset("\u00AD\u200B\u200C\u200D\u2060\uFEFF")


def _fold(c: str) -> str | None:
    """The ASCII text that a non-ASCII character disguises, or None."""
    known = process_cache("folds")
    if c not in known:
        out = "" if c in _INVISIBLE else _CYRILLIC_GREEK.get(c) or _SIGNS.get(c)
        if out is None:
            digit = unicodedata.digit(c, None) if unicodedata.category(c) == "Nd" else None
            if digit is not None:
                out = str(digit)
            elif "！" <= c <= "～" or "\U0001d400" <= c <= "\U0001d7ff":
                plain = unicodedata.normalize("NFKC", c)
                out = plain if len(plain) == 1 and plain.isascii() else None
        if len(known) > 1 << 16:
            known.clear()
        known[c] = out
    return known[c]


class Tape:
    """A rewritten text; from[i] and to[i] are the source offsets of its character i."""

    def __init__(self, text: str):
        self.text, self.first, self.last, self.touched = text, None, None, []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the stretches start:end (in order, apart) by short texts."""
        if not edits:
            return
        if self.first is None:
            self.first = array("q", range(len(self.text)))
            self.last = array("q", range(1, len(self.text) + 1))
        text, first, last, touched = [], array("q"), array("q"), []
        old, at, shift = iter(self.touched), 0, 0
        pending = next(old, None)
        for start, end, new in [*edits, (len(self.text), len(self.text), "")]:
            while pending is not None and pending < start:
                touched.append(pending + shift)
                pending = next(old, None)
            while pending is not None and pending < end:
                pending = next(old, None)
            text.append(self.text[at:start])
            first += self.first[at:start]
            last += self.last[at:start]
            if new or end > start:
                touched.append(len(first))
            if new:
                text.append(new)
                first += array("q", [self.first[start]] * len(new))
                last += array("q", [self.last[end - 1]] * len(new))
            shift += len(new) - (end - start)
            at = end
        self.text, self.first, self.last, self.touched = "".join(text), first, last, sorted(set(touched))

    def source(self, start: int, end: int) -> tuple[int, int] | None:
        """Source offsets of start:end if a rewritten character lies in it."""
        i = bisect_left(self.touched, start)
        if i == len(self.touched) or self.touched[i] >= end:
            return None
        return self.first[start], self.last[end - 1]


#: Number words of English, German, French and Spanish.
NUMBER_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NUMBER = "|".join(sorted(NUMBER_WORDS, key=lambda w: (-len(w), w)))
_AT, _DOT = r"(?:at|arroba|arobase)", r"(?:dot|punto|punkt|point)"
_SEP = r"[ ,;-]++"
_SPELLED_HINT = re.compile(rf"\b(?:{_NUMBER}){_SEP}(?:{_NUMBER})\b", re.IGNORECASE)
_RUN = re.compile(rf"(?:\b(?:plus|más){_SEP})?(?<![^\W\d_])(?:{_NUMBER}|[0-9])(?:(?:[ ,;-]*+{_DOT}[ ,;-]*+|[ ]*+\.[ ]*+|{_SEP})?(?:{_NUMBER}|[0-9])){{2,}}(?![^\W\d_])", re.IGNORECASE)
_PIECE = re.compile(rf"(?P<plus>(?:plus|más){_SEP})|(?P<word>{_NUMBER})|(?P<dot>[ ,;-]*+{_DOT}[ ,;-]*+)|(?P<digit>[0-9])|(?P<gap>[ ]*+\.[ ]*+|{_SEP})", re.IGNORECASE)
_LOOKALIKE = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl]{2,}+(?![A-Za-z0-9])")
_LOOKALIKE_IP = re.compile(r"(?<![A-Za-z0-9.])[0-9OoIl]++(?:\.[0-9OoIl]++){3}(?![A-Za-z0-9]|\.[A-Za-z0-9])")
_LOOKALIKE_HINT = re.compile(r"[0-9][OoIl.]|[OoIl.][0-9]")
_APART = re.compile(r"(?<!\S)\S(?: \S(?!\S)){5,}+")
_CORE = re.compile(rf"[\[({{<]\s*+(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.))\s*+[\])}}>]|(?P<at2>&(?:#64|#x40|commat);|%40)|(?P<dot2>&(?:#46|#x2e|period);)", re.IGNORECASE)
_AT_SIGN = re.compile(rf"(?<=\s){_AT}(?=\s)|@", re.IGNORECASE)
_DOT_RIGHT = re.compile(rf"\s++{_DOT}\s++|\s*+\.\s*+", re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_SPOKEN_HINT = re.compile(rf"\s{_DOT}\s|\s@|@\s", re.IGNORECASE)
_WORDS_LEFT = re.compile(rf"\s{_DOT}\s", re.IGNORECASE)
_DOT_WORDS = frozenset(["dot", "punto", "punkt", "point"])


def _homoglyph_edits(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    folds = {c: f for c in set(text) if c > "\x7f" and (f := _fold(c)) is not None}
    if not folds:
        return []
    pattern = re.compile("[" + re.escape("".join(folds)) + "]")
    return [(m.start(), m.end(), folds[m.group()]) for m in pattern.finditer(text)]


def _lookalike_edits(text: str) -> list[tuple[int, int, str]]:
    """Letters that stand for digits inside runs that are digits for the most part, or in dotted quads with a digit."""
    if not _LOOKALIKE_HINT.search(text):
        return []
    at = set()
    for m in _LOOKALIKE.finditer(text):
        letters = [i for i, c in enumerate(m.group(), m.start()) if c > "9"]
        if 2 * len(letters) <= len(m.group()):
            at.update(letters)
    for m in _LOOKALIKE_IP.finditer(text):
        if _DIGIT.search(m.group()):
            at.update(i for i, c in enumerate(m.group(), m.start()) if c > "9")
    return [(i, i + 1, "0" if text[i] in "Oo" else "1") for i in sorted(at)]


def _apart_edits(text: str) -> list[tuple[int, int, str]]:
    """Blanks between single characters that together are an address, an IP or a phone number."""
    edits = []
    for m in _APART.finditer(text):
        closed = m.group()[::2]
        if plain_spans(closed):
            edits += [(i, i + 1, "") for i in range(m.start() + 1, m.end(), 2)]
    return edits


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    if not _SPELLED_HINT.search(text):
        return []
    edits = []
    for m in _RUN.finditer(text):
        pieces = list(_PIECE.finditer(m.group()))
        if sum(p.lastgroup == "word" for p in pieces) < 3:
            continue
        base = m.start()
        for p in pieces:
            kind = p.lastgroup
            new = {"word": NUMBER_WORDS.get(p.group().lower(), ""), "plus": "+", "dot": ".", "gap": "." if "." in p.group() else ""}.get(kind, p.group())
            if new != p.group():
                edits.append((base + p.start(), base + p.end(), new))
    return edits


def _bracket_edits(text: str) -> list[tuple[int, int, str]]:
    """Bracketed or encoded signs, with the blanks around them."""
    edits, free = [], 0
    for m in _CORE.finditer(text):
        start, end = m.span()
        while start > free and text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        free = end
        edits.append((start, end, "@" if m.group("at") or m.group("at2") else "."))
    return edits


def _left_of(text: str, end: int, free: int) -> tuple[int, list[tuple[int, int]]] | None:
    """Start of the local part that ends at end, and its spoken dots, last first; nothing before free is read."""
    dots, start = [], end
    while True:
        begin = start
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin == start:
            return None if not dots else (dots[-1][1], dots[:-1])
        start = begin
        # a spoken dot and another label before it?
        gap = begin
        while gap > free and text[gap - 1].isspace():
            gap -= 1
        word = gap
        while word > free and text[word - 1].isalpha():
            word -= 1
        lead = word
        while lead > free and text[lead - 1].isspace():
            lead -= 1
        if gap == begin or lead == word or text[word:gap].lower() not in _DOT_WORDS:
            return start, dots
        dots.append((lead, begin))
        start = lead


def _right_of(text: str, start: int) -> list[tuple[int, int, int]]:
    """The host from start on: start and end of each label and where the dot before it began; empty if it is none."""
    labels, at, dot = [], start, start
    while m := _LABEL.match(text, at):
        labels.append((m.start(), m.end(), dot))
        sign = _DOT_RIGHT.match(text, m.end())
        if not sign:
            break
        dot, at = m.end(), sign.end()
    while labels and not (text[labels[-1][0] : labels[-1][1]].isalpha() and labels[-1][1] - labels[-1][0] >= 2):
        labels.pop()
    return labels if len(labels) > 1 else []


def _spoken_edits(text: str) -> list[tuple[int, int, str]]:
    """Addresses with spaced signs: the dot must be disguised too, or a spaced at-sign stand."""
    if not _SPOKEN_HINT.search(text):
        return []
    edits, free = [], 0
    for m in _AT_SIGN.finditer(text):
        if m.start() < free:
            continue
        begin, end = m.span()
        while begin > free and text[begin - 1].isspace():
            begin -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        sign = m.group() == "@"
        host = _right_of(text, end)
        local = _left_of(text, begin, free) if host else None
        if not local or not host:
            continue
        start, dots = local
        gaps = [(d, a) for a, _, d in host[1:]]
        spoken = bool(dots) or any(_WORDS_LEFT.search(text, d, a) for d, a in gaps)
        if not spoken and not (sign and end - begin > 1):
            continue
        if sign and any("." in text[d:a] and text[d:a][-1].isspace() for d, a in gaps):
            continue  # a sentence end, not a host
        found = [(d, a, ".") for d, a in dots[::-1]]
        if text[begin:end] != "@":
            found.append((begin, end, "@"))
        edits += found + [(d, a, ".") for d, a in gaps if text[d:a] != "."]
        free = host[-1][1]
    return edits


def _grows(text: str, plain: tuple[int, int], span: tuple[int, int]) -> bool:
    """Whether the span goes on where the plain one broke off at a disguised letter."""
    more = text[span[0] : plain[0]] + text[plain[1] : span[1]]
    return span[0] <= plain[0] and plain[1] <= span[1] and more != "" and all(c.isalnum() or c in _INVISIBLE for c in more)


def disguised_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of disguised identifiers, in source offsets; they overlap no plain span of their kind but to complete it."""
    tape = Tape(text)
    for transducer in (_homoglyph_edits, _apart_edits, _lookalike_edits, _spelled_edits, _bracket_edits, _spoken_edits):
        tape.rewrite(transducer(tape.text))
    if not tape.touched:
        return []
    out = []
    for kind, start, end in plain_spans(tape.text):
        at = tape.source(start, end)
        if at and all(k != kind or s >= at[1] or at[0] >= e or _grows(text, (s, e), at) for k, s, e in plain):
            out.append((kind, *at))
    return out


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The plain spans of a text, and all its spans."""
    plain = plain_spans(text or "")
    extra = disguised_spans(text or "", plain)
    return plain, sorted(plain + extra, key=lambda s: (s[1], KINDS.index(s[0]))) if extra else plain


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"


def _detect(batches):
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            plain, spans = find(text)
            kinds = [k for k, _, _ in plain]
            rows.append((*map(kinds.count, KINDS), hashlib.sha256(_joined(plain).encode()).hexdigest(), _joined(spans), len(spans) - len(plain)))
        columns = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")]
        )


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of docs: counts and digest of the plain spans, all spans, n_disguised.

    Offsets count code points, ends are exclusive. A null text is empty and has no spans; its
    digest is that of the empty string. Very long texts are read whole, in linear time. Spans that
    start together come in the order of KINDS. Repeated rows and null ids are treated like any
    other; an empty table gives an empty result; further columns of docs are ignored.
    """
    common.prepare(docs.sparkSession)
    return id_text(docs).mapInArrow(_detect, SCHEMA)


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end in find(text)[1]:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def _redact(batches):
    for batch in batches:
        names = batch.schema.names
        texts = [redacted(t) for t in batch.column("text").to_pylist()]
        batch = batch.set_column(names.index("text"), batch.schema.field("text"), pa.array(texts, pa.string()))
        if "n_chars" in names:
            field = batch.schema.field("n_chars")
            batch = batch.set_column(names.index("n_chars"), field, pa.array([None if t is None else len(t) for t in texts], field.type))
        yield batch


def redact(docs: DataFrame) -> DataFrame:
    """docs with all spans of text replaced by placeholders, and n_chars (if there) set anew.

    Null texts stay null, empty ones empty; very long ones are read whole. Repeated rows and null
    ids are treated like any other; all columns stay, whatever their names; an empty table gives
    an empty result.
    """
    common.prepare(docs.sparkSession)
    return docs.mapInArrow(_redact, docs.schema)
