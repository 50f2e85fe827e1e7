"""Secret scan: fixed credential patterns, and zstandard novelty against primed dictionaries.

Base spans come from three patterns (`assign`, `access`, `hex`). The method adds spans of kind
`novel`: a candidate is a token of `LEAST` characters or more that begins closely after a sensitive
word and mixes letters with digits, or, in a run of letters, capitals with small letters beyond the
first one. Words in one case, and numbers, are never measured: a compressor has no more explanation for a rare word than
for a random one, so that secrets of this form are found by the base patterns alone. A zstandard compressor is primed with a dictionary of code and identifiers; the candidate's
marginal size, compressed(context + candidate) - compressed(context), tells how much of it the
dictionary and the surrounding text explain. What they do not explain is reported.

Null and empty texts have no spans. Whole texts are scanned. Each row stands alone, so repeated
rows get equal results, an empty table gives an empty result, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"
#: The base kinds, in order, then the kind of the added spans.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "novel")
_RANK = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A greedy run that is long enough starts where its run starts, so this equals all runs, filtered.
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that make a context sensitive.
SENSITIVE_WORDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api key", "api_key", "api-key", "access key", "access_key", "private key", "private_key", "credential", "bearer", "authorization", "auth_", "session_id", "signature")
_SENSITIVE = re.compile("|".join(re.escape(w) for w in sorted(SENSITIVE_WORDS, key=len, reverse=True)), re.ASCII | re.IGNORECASE)
#: Characters of a token that is measured, as many as the base pattern `assign` asks for.
LEAST = 8
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_MIXED = re.compile(r"[A-Za-z].*[0-9]|[0-9].*[A-Za-z]|[a-z][A-Za-z]*[A-Z]|[A-Z][A-Za-z]*[A-Z][A-Za-z]*[a-z]")

#: What code and configuration near a secret usually consist of.
DICTIONARY = """
import os sys json logging config settings environment variables export default function return const let var
class public static final void string int bool true false null none self this new try except catch finally
def main args kwargs request response headers content-type application/json charset=utf-8 authorization bearer
username password passwd secret token api_key apikey access_key private_key client_id client_secret credentials
http:// https:// localhost 127.0.0.1 example.com /usr/local/bin /etc/config /var/log/ .json .yaml .env .py .js .html
select from where insert into values update set delete create table primary key index not null timestamp
production development staging test sample example placeholder changeme your-token-here your_api_key_here
version 1.0.0 2.0.0 3.1.4 2020-01-01 2021-01-01 2022-01-01 2023-01-01 2024-01-01 T00:00:00Z 00000000 12345678 1234567890
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef deadbeef
"""


class Novelty:
    """Marginal compressed bytes of a string against a primed dictionary and its context."""

    def __init__(self, dictionary: str = DICTIONARY, level: int = 12):
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._size = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False).compress

    def share(self, context: str, candidate: str) -> float:
        """Marginal bytes per byte of `candidate`, which stands after `context`."""
        before, added = context.encode(), candidate.encode()
        return (len(self._size(before + added)) - len(self._size(before))) / max(1, len(added))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base patterns: leftmost, not overlapping within a kind; failing matches go."""
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def novel_spans(text: str, novelty: Novelty, taken: list[tuple[str, int, int]], min_share: float, reach: int, context: int) -> list[tuple[str, int, int]]:
    """Tokens that begin within `reach` characters after a sensitive word and that the compressor cannot explain."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    found, last = [], 0
    for word in _SENSITIVE.finditer(text):
        for m in _CANDIDATE.finditer(text, max(word.end(), last), min(len(text), word.end() + reach + LEAST - 1)):
            whole = _CANDIDATE.match(text, m.start())  # a token may reach beyond the window
            a, b = whole.span()
            last = max(last, b)
            token = whole[0]
            if not _MIXED.search(token):
                continue
            if any(a < e and s < b for _, s, e in taken):
                continue
            around = text[b : b + context] + "\n" + text[max(0, a - context) : a]
            if novelty.share(around, token) >= min_share:
                found.append(("novel", a, b))
    return found


def secret_spans(text: Column, min_share: float = 0.55, reach: int = 64, context: int = 256) -> Column:
    """All spans of a text column as array<struct<kind, start, end>>, by start, then kind; offsets count code points.

    A span of kind `novel` begins within `reach` characters after a sensitive word, overlaps no base
    span, and has a marginal compressed size of `min_share` or more of its length, given `context`
    characters on either side.
    """

    @F.arrow_udf(SPAN_TYPE)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        novelty = Novelty()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = []
            for cell in batch:
                value = cell.as_py()
                if not value:
                    rows.append([])
                    continue
                spans = base_spans(value)
                spans += novel_spans(value, novelty, spans, min_share, reach, context)
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2]))])
            yield pa.array(rows, kind)

    return scan(text)


def scan_secrets(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """`docs` with the column `secrets` (see `secret_spans`); an input column of that name is replaced."""
    return docs.withColumn("secrets", secret_spans(F.col(text_col), **options))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """`text` with every span replaced by `mark`; spans that touch or overlap become one mark.

    Null stays null; a text without spans is unchanged.
    """
    step = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["done"]).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(step["done"], F.substring(text, step["at"] + 1, F.length(text)))).otherwise(text)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of `documents`; the digest columns follow from the operator's spans."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), count("novel"))
