"""Column functions on transaction texts. All are built-in expressions unless the name says otherwise."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Latin letters with marks, and what they are without.
_MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_BARE = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def is_ascii(text: Column) -> Column:
    """Whether a text has no character beyond ASCII, by its lengths."""
    return F.is_valid_utf8(text) & (F.octet_length(text) == F.char_length(text))


def ascii_fold(text: Column) -> Column:
    """Latin letters without their marks; other characters beyond ASCII go."""
    return F.when(is_ascii(text), text).otherwise(F.regexp_replace(F.translate(text, _MARKED, _BARE), r"[^\x00-\x7F]", ""))


@F.arrow_udf(T.StringType())
def nfkd_ascii(text: pa.Array) -> pa.Array:
    """Exact NFKD, ASCII only: for scripts where `ascii_fold` is too coarse."""
    return pa.array([None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() for v in text.to_pylist()], pa.string())


def collapse(text: Column) -> Column:
    """Runs of white space as one space, trimmed. Texts of ASCII without any run are left as they are."""
    single = is_ascii(text) & ~contains_any(text, ("  ", "\t", "\n", "\x0b", "\x0c", "\r"))
    return F.trim(F.when(single, text).otherwise(F.regexp_replace(text, r"(?U)\s+", " ")))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match or where the group is empty."""
    return bound(F.regexp_extract(text, pattern, group), lambda v: F.when(v != "", v))  # searched once


def first_found(text: Column, patterns: list[str], group: int = 1) -> Column:
    return F.coalesce(*[found(text, p, group) for p in patterns])


def number(text: Column, kind: str = "double") -> Column:
    """A number with commas; null where it is none."""
    return F.regexp_replace(text, ",", "").try_cast(kind)


def bound(value: Column, use) -> Column:
    """`use` of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parsed_date(text: Column) -> Column:
    """A date in one of eight forms, year first before day first; two-digit years pivot at 69."""
    # a form that does not fit costs an exception: it is tried only on a text with what the form must hold
    last = r"[+-]?\d{2}$"
    forms = {"yyyy-M-d": r"\d{4}-", "yyyy/M/d": r"\d{4}/", "d-M-yyyy": r"-[+-]?\d{4}", "d/M/yyyy": r"/[+-]?\d{4}", "d-M-yy": f"-{last}", "d/M/yy": f"/{last}", "d MMM yyyy": " ", "d MMMM yyyy": " "}
    read = lambda t: F.coalesce(*[F.when(t.rlike(needs), F.try_to_timestamp(t, F.lit(f))) for f, needs in forms.items()]).cast("date")
    return bound(bound(text, read), lambda day: F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day))


def first_date(texts: list[Column]) -> Column:
    """The first of several texts that is a date."""
    return F.get(F.filter(F.transform(F.array(*texts), parsed_date), lambda d: d.isNotNull()), F.lit(0))


def contains_any(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def share_of(text: Column, pattern: str) -> Column:
    """Matches of a one-character pattern per character."""
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def word_count(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def slug(text: Column, joint: str = "_") -> Column:
    """Lower case, runs of other characters than letters and digits as `joint`, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", joint), f"^{joint}|{joint}$", "")


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text without spaces; a shorter text is one of its own."""
    t = F.replace(text, F.lit(" "), F.lit(""))
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))
    return F.when(F.length(t) < 3, F.array(t)).otherwise(many)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def variants(text: Column) -> Column:
    """Up to five distinct spellings: upper, lower, hyphens and slashes as spaces, no spaces."""
    return F.slice(F.array_distinct(F.array(F.upper(text), F.lower(text), F.replace(text, F.lit("-"), F.lit(" ")), F.replace(text, F.lit("/"), F.lit(" ")), F.replace(text, F.lit(" "), F.lit("")))), 1, 5)


def cache_key(*parts: Column) -> Column:
    """sha256 over a canonical form: null and empty differ, and no float is printed raw."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def cache_digest(*parts: Column) -> Column:
    """The 32 bytes that `cache_key` writes as digits."""
    return F.unhex(cache_key(*parts))


def embedded_json(text: Column) -> Column:
    """From the first { to the last } of a text."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def sequence_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratcliff-Obershelp similarity of two texts, null below `least`; there is no built-in for it.

    Counts of characters bound the similarity from above, so that most pairs below `least` are not
    aligned; pairs with the same `b` share what is prepared for it.
    """

    @F.arrow_udf(T.DoubleType())
    def ratios(left: pa.Array, right: pa.Array) -> pa.Array:
        from difflib import SequenceMatcher

        out: list[float | None] = [None] * len(left)
        by: dict[str, list[int]] = {}
        texts = left.to_pylist()
        for i, y in enumerate(right.to_pylist()):
            if y is not None and texts[i] is not None:
                by.setdefault(y, []).append(i)
        for y, rows in by.items():
            m = SequenceMatcher(None, "", y)
            for i in rows:
                m.set_seq1(texts[i])
                if m.quick_ratio() >= least and (found := m.ratio()) >= least:
                    out[i] = found
        return pa.array(out, pa.float64())

    return ratios(a, b)
