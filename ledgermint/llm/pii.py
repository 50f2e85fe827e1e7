"""Personal data: base patterns, and offset-preserving deobfuscation.

Base spans come from four patterns on the text as it is. The method adds spans: transducers rewrite
homoglyphs, spelled digits and at/dot disguises, and keep for every output character the source
span it came from; the same patterns then run on the rewritten text, and what they find is mapped
back to source characters. An added span overlaps no base span and covers a rewritten place.

Null and empty texts have no spans; whole texts are scanned; rows stand alone and nothing is
shuffled, so repeated rows get equal results and an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .secrets import SPAN_TYPE, joined

#: The kinds, in order.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns are `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`, `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`,
#: `[0-9]([\x20-]?[0-9])+` and `\+[0-9][\x20().0-9-]+[0-9]`. Below they stand in forms that find the same spans in time
#: that grows with the text alone: an address is found from its sign, and no run is tried again from its middle.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Letters of other scripts that look like Latin ones, then the Latin ones.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ı": "i",
}
#: Characters that show nothing, and dashes.
INVISIBLE = "​‌‍‎‏⁠﻿­"
DASHES = "‐‑‒–—―−"
#: Words for the digits 0 to 9 in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT_WORDS, _DOT_WORDS = "at|arroba|arobase|ät", "dot|punto|punkt|point"
_ODD = re.compile("[" + re.escape("".join(LOOKALIKES)) + INVISIBLE + DASHES + " ․ 。！-～﹒﹫٠-٩۰-۹०-९⁰-₉Ⓐ-ⓩ①-⑨⓪\U0001d400-\U0001d7ff]")
#: Marks in brackets; white space before them is taken as well, see `_marks`.
_AT_MARK = re.compile(rf"(?:\(\s*+(?:{_AT_WORDS}|@)\s*+\)|\[\s*+(?:{_AT_WORDS}|@)\s*+\]|\{{\s*+(?:{_AT_WORDS}|@)\s*+\}}|<\s*+(?:{_AT_WORDS}|@)\s*+>)\s*+", re.IGNORECASE)
_DOT_MARK = re.compile(rf"(?:\(\s*+(?:{_DOT_WORDS}|\.)\s*+\)|\[\s*+(?:{_DOT_WORDS}|\.)\s*+\]|\{{\s*+(?:{_DOT_WORDS}|\.)\s*+\}}|<\s*+(?:{_DOT_WORDS}|\.)\s*+>)\s*+", re.IGNORECASE)
_BRACKETED = re.compile(rf"[(\[{{<]\s*+(?:{_AT_WORDS}|{_DOT_WORDS}|@|\.)\s*+[)\]}}>]", re.IGNORECASE)
#: name at host dot tld, in words; each may instead be a sign with spaces around it.
_WORDED = re.compile(rf"(?<![\w.%+-])[A-Za-z0-9._%+-]++(?P<at>\s+(?:{_AT_WORDS}|@)\s+|\s*@\s*)[A-Za-z0-9-]+(?P<rest>(?:(?:\s+(?:{_DOT_WORDS}|\.)\s+|\.)[A-Za-z0-9-]+)*(?:\s+(?:{_DOT_WORDS}|\.)\s+)[A-Za-z0-9-]+)", re.IGNORECASE)
_WORDED_DOT = re.compile(rf"\s+(?:{_DOT_WORDS}|\.)\s+", re.IGNORECASE)
_DIGIT_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:(?:plus|\+)[\s,-]*)?(?:(?:{_DIGIT_WORD}|[0-9]+)(?:[\s,-]+|\s+(?:{_DOT_WORDS})\s+|\s*\.\s*))*(?:{_DIGIT_WORD}|[0-9]+)(?!\w)", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"(?P<plus>plus[\s,-]*)|(?P<digit>{_DIGIT_WORD})|(?P<dot>\s*(?<!\w)(?:{_DOT_WORDS})(?!\w)\s*)|(?P<gap>[\s,-]+)", re.IGNORECASE)
#: A run of spelled digits without any of these is not looked for.
_TELLING = [w for w in DIGIT_WORDS if len(w) > 3 or w in ("one", "two", "six", "dos", "uno")]
_TWO_WORDS = re.compile(rf"(?<!\w)(?:{_DIGIT_WORD})[\s,-]+(?:{_DIGIT_WORD}|{_DOT_WORDS})(?!\w)", re.IGNORECASE)


def luhn(digits: str) -> bool:
    """Whether the checksum of card numbers holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The spans of addresses: for each sign, the local part that ends there and the domain that follows."""
    last, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, sign + 1) if start < sign else None
        if m:
            yield start, m.end()
        last = m.end() if m else sign + 1
        sign = text.find("@", last)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base patterns, by kind, then start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


class Mapped:
    """A text under rewriting. Each pass keeps its edits, so a place is led back through the passes; memory grows with the edits."""

    def __init__(self, text: str):
        self.text, self.passes = text, []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace each [a, b) by a string; edits are in order and do not overlap."""
        if not edits:
            return
        text, at, shift, places = [], 0, 0, ([], [], [], [])
        for a, b, new in edits:
            text += (self.text[at:a], new)
            for values, value in zip(places, (a, b, a + shift, a + shift + len(new)), strict=True):
                values.append(value)
            at, shift = b, shift + len(new) - (b - a)
        self.text = "".join(text) + self.text[at:]
        self.passes.append(places)

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source span of [a, b), which is not empty; a character that an edit made stands for all that the edit replaced."""
        last = b - 1
        for starts, ends, new_starts, new_ends in reversed(self.passes):
            k = bisect_right(new_starts, a) - 1
            a = a if k < 0 else starts[k] if a < new_ends[k] else ends[k] + a - new_ends[k]
            k = bisect_right(new_starts, last) - 1
            last = last if k < 0 else ends[k] - 1 if last < new_ends[k] else ends[k] + last - new_ends[k]
        return a, last + 1

    def place(self, i: int) -> int:
        """Where the last pass moved a place between its edits."""
        starts, ends, _, new_ends = self.passes[-1]
        k = bisect_right(ends, i) - 1
        return i if k < 0 else new_ends[k] + i - ends[k]


class Spans:
    """Intervals, and whether another one overlaps any of them. Added ones may overlap what is there."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a

    def add(self, a: int, b: int) -> None:
        """Adds an interval that meets none."""
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def plain(c: str) -> str:
    """The ASCII character that `c` looks like; nothing for an invisible one; else `c`."""
    if c in INVISIBLE:
        return ""
    if c in DASHES:
        return "-"
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in "․。":
        return "."
    if c.isdigit() and (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


def _homoglyphs(m: Mapped) -> None:
    m.rewrite([(x.start(), x.end(), new) for x in _ODD.finditer(m.text) if (new := plain(x[0])) != x[0]])


def _marks(pattern: re.Pattern, text: str, new: str) -> list[tuple[int, int, str]]:
    """Edits that put `new` in the place of each mark and the white space around it."""
    edits, last = [], 0
    for x in pattern.finditer(text):
        a = x.start()
        while a > last and text[a - 1].isspace():
            a -= 1
        last = x.end()
        edits.append((a, last, new))
    return edits


def _disguises(m: Mapped) -> None:
    low = m.text.lower()
    if any(b in low for b in "([{<") and _BRACKETED.search(m.text):
        m.rewrite(_marks(_AT_MARK, m.text, "@"))
        m.rewrite(_marks(_DOT_MARK, m.text, "."))
    if any(f" {w} " in low for w in ("dot", "punto", "punkt", "point", ".")):
        edits = []
        for x in _WORDED.finditer(m.text):
            edits.append((*x.span("at"), "@"))
            edits += [(y.start(), y.end(), ".") for y in _WORDED_DOT.finditer(m.text, *x.span("rest"))]
        m.rewrite(edits)


def _spelled(m: Mapped) -> list[tuple[int, int]]:
    """Rewrites runs of spelled digits; returns where the runs stand then."""
    low = m.text.lower()
    if not any(w in low for w in _TELLING) or not _TWO_WORDS.search(m.text):
        return []
    edits, runs = [], []
    for x in _SPELLED.finditer(m.text):
        parts = list(_SPELLED_PART.finditer(m.text, *x.span()))
        words = sum(p.lastgroup == "digit" for p in parts)
        if words < 2:
            continue
        if words + sum(c.isdigit() for c in x[0]) < 4:
            continue
        for p in parts:
            new = {"plus": "+", "digit": DIGIT_WORDS.get(p[0].lower(), ""), "dot": ".", "gap": ""}[p.lastgroup]
            edits.append((p.start(), p.end(), new))
        runs.append(x.span())
    m.rewrite(edits)
    return [(m.place(a), m.place(b)) for a, b in runs]


def hidden_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows, in source characters."""
    m = Mapped(text)
    if not text.isascii():
        _homoglyphs(m)
    _disguises(m)
    runs = _spelled(m)
    if not m.passes:
        return []
    found = []
    for kind, a, b in base_spans(m.text):
        s, e = m.source(a, b)
        if text[s:e] != m.text[a:b]:
            found.append((kind, s, e))
    shown = Spans((a, b) for _, a, b in found)
    for a, b in runs:  # spoken without a plus: a run of the length of a phone number
        said = m.text[a:b]
        if said and "." not in said and 9 <= sum("0" <= c <= "9" for c in said) <= 15:
            s, e = m.source(a, b)
            if not shown.meets(s, e):
                found.append(("phone", s, e))
    base, kept, of_kind = Spans((a, b) for _, a, b in taken), [], {k: Spans() for k in KINDS}
    for kind, s, e in found:
        if not base.meets(s, e) and not of_kind[kind].meets(s, e):
            of_kind[kind].add(s, e)
            kept.append((kind, s, e))
    return kept


def pii_spans(text: Column) -> Column:
    """struct<base, all>, each array<struct<kind, start, end>> by kind, then start; offsets count code points."""

    @F.arrow_udf(f"struct<base:{SPAN_TYPE},all:{SPAN_TYPE}>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        both = pa.struct([("base", spans), ("all", spans)])
        order = lambda s: (KINDS.index(s[0]), s[1], s[2])
        named = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in sorted(found, key=order)]
        for batch in batches:
            rows = []
            for cell in batch:
                value = cell.as_py()
                base = base_spans(value) if value else []
                hidden = hidden_spans(value, base) if value else []
                first = named(base)
                rows.append({"base": first, "all": named([*base, *hidden]) if hidden else first})
            yield pa.array(rows, both)

    return scan(text)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the column `pii`: struct<base, all> of spans; an input column of that name is replaced."""
    return docs.withColumn("pii", pii_spans(F.col(text_col)))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every whole text of `documents`; counts and `base_sha256` are of the base spans."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.col("pii.base")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii.all")).alias("spans"), (F.size("pii.all") - F.size("pii.base")).cast("long").alias("n_hidden"))
