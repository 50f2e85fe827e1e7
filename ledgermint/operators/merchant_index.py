"""A compiled gazetteer: merchants are found within the row, so that a stream needs neither state nor jobs per batch.

`operators.resolve` joins distinct texts with names and groups what it finds by text. On a stream such groups would
need state and a watermark. Here Spark orders the tokens of every name, rarest first, and keeps the prefix that a match
must share (see `operators.similarity`); the lists of names by prefix token are broadcast, each text looks up all of
its tokens, and only the names found are compared. The merchant's columns come with the answer: a join by it would
make the optimizer trace the key through every expression of the text below it.
The answers are those of `resolve.attach_merchant`: no name that reaches the threshold is left out.

The lists are held by every Python worker, so that an index is bounded by `MOST_NAMES` names and `MOST_CHARACTERS`
characters; beyond either it is an error, and `resolve` (in batch, or by `route.stream_categorize`) has no such bound.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermint.functions.text import trigrams

from .resolve import SHORTEST, SUBSTRING_SCORE, aliases, clean_merchant, listed_names
from .similarity import _EPS, _counted, _places, rare_first, token_counts

#: Names, and characters of names with their merchants' columns, that an index may have (a few kilobytes of lists a name of usual length).
MOST_NAMES, MOST_CHARACTERS = 50_000, 2_000_000
#: Texts whose answer a task remembers, and names that it has prepared for alignment.
REMEMBERED, PREPARED = 20_000, 2_000


def _grams(text: str) -> set[str]:
    """As `functions.text.trigrams`."""
    bare = text.replace(" ", "")
    return {bare[i : i + 3] for i in range(len(bare) - 2)} if len(bare) >= 3 else {bare}


def _numbered(text: str, width: int) -> list[str]:
    """The runs of `width` characters, each with how often it has occurred so far; as `similarity` names its tokens."""
    seen: Counter[str] = Counter()
    out = []
    for i in range(len(text) - width + 1):
        run = text[i : i + width]
        seen[run] += 1
        out.append(f"{run}\x1f{seen[run]}")
    return out


class Finder:
    """The best merchant of a text, from the lists of an index; made once a task."""

    def __init__(self, lists: dict, threshold: float, fuzzy: bool):
        self.lists, self.threshold, self.fuzzy = lists, threshold, fuzzy
        self.best = lru_cache(REMEMBERED)(self._best)
        self._prepared = lru_cache(PREPARED)(self._prepare)

    @staticmethod
    def _prepare(name: str):
        from difflib import SequenceMatcher

        return SequenceMatcher(None, "", name)

    def _sure(self, text: str) -> tuple[int, float, str] | None:
        whole = self.lists["exact"].get(text)
        if whole is not None:
            return whole, 1.0, "exact"
        heads, first = self.lists["heads"], None
        for i in range(len(text) - SHORTEST + 1):
            for pos, name, row in heads.get(text[i : i + SHORTEST], ()):
                if (first is None or pos < first[0]) and text.startswith(name, i):
                    first = pos, row
        return None if first is None else (first[1], SUBSTRING_SCORE, "substring")

    def _similar(self, text: str) -> Iterator[tuple[float, int, int, str]]:
        """(-score, row, way, match type) of every name that reaches the threshold."""
        mine, t = _grams(text), self.threshold
        for k in {k for g in mine for k in self.lists["grams"].get(g, ())}:
            name, row = self.lists["listed"][k]
            other = _grams(name)
            common = len(mine & other)
            score = common / (len(mine) + len(other) - common)
            if score >= t:
                yield -score, row, 1, "trigram"
        if not self.fuzzy:
            return
        near = {k for width in (1, 2) for token in _numbered(text, width) for k in self.lists["runs"].get(token, ())}
        for k in near:
            name, row = self.lists["names"][k]
            if 2 * min(len(text), len(name)) < t * (len(text) + len(name)) - _EPS:
                continue
            m = self._prepared(name)
            m.set_seq1(text)
            if m.quick_ratio() >= t and (score := m.ratio()) >= t:
                yield -score, row, 0, "alias"

    def _best(self, text: str) -> tuple[int, float, str] | None:
        """(row, score, match type): the sure name, which ends the search, else the highest score; of equal ones the first row, and the aligned name before the trigrams."""
        if not text:
            return None
        found = self._sure(text)
        if found is None:
            best = min(self._similar(text), default=None)
            found = None if best is None else (best[1], -best[0], best[3])
        return found if found is not None and found[1] >= self.threshold else None


@dataclass
class MerchantIndex:
    """A gazetteer compiled for searches from `threshold` on."""

    lists: Broadcast
    threshold: float
    fuzzy: bool

    def attach(self, df: DataFrame, source: str = "merchant", threshold: float = 0.8, text: str | None = None, text_threshold: float = 0.7) -> DataFrame:
        """`df`, which may be a stream, with the columns of `resolve.attach_merchant`; both thresholds must be at least that of the index.

        Null and empty texts match nothing. Rows are judged one by one, so repeated rows get equal answers, and an
        empty table or an empty gazetteer gives no match.
        """
        if min(threshold, text_threshold if text else threshold) < self.threshold:
            raise ValueError(f"the index was compiled for thresholds of {self.threshold} or more")
        lists, least, fuzzy = self.lists, self.threshold, self.fuzzy
        shown = ["merchant_resolved", "merchant_category", "merchant_subcategory"]
        kind = pa.struct([*[(c, pa.string()) for c in shown], ("merchant_score", pa.float64())])

        @F.arrow_udf(f"struct<{', '.join(f'{c}:string' for c in shown)}, merchant_score:double>")
        def match(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            finder, merchants = Finder(lists.value, least, fuzzy), lists.value["merchants"]
            for whole, named in batches:
                out = []
                for x, y in zip(whole.to_pylist(), named.to_pylist(), strict=True):
                    hit = finder.best(x) if x else None
                    if hit is None or hit[1] < text_threshold:
                        hit = finder.best(y) if y else None
                        hit = hit if hit is not None and hit[1] >= threshold else None
                    out.append(None if hit is None else dict(zip(shown, merchants[hit[0]], strict=True)) | {"merchant_score": hit[1]})
                yield pa.array(out, kind)

        whole = clean_merchant(F.col(text)) if text else F.lit("")
        found = df.withColumn("_hit", match(whole, clean_merchant(F.col(source))))
        return found.select(*df.columns, *[F.col(f"_hit.{c}").alias(c) for c in (*shown, "merchant_score")])


def compile_index(gazetteer: DataFrame, threshold: float = 0.7, fuzzy: bool = True) -> MerchantIndex:
    """The index of a gazetteer: its names are counted, then their tokens are ordered and cut by Spark; run once, before a query starts.

    An empty gazetteer gives an index that finds nothing. More names than `MOST_NAMES`, or longer ones than
    `MOST_CHARACTERS` together, are an error.
    """
    t = threshold
    listed, names = listed_names(gazetteer), aliases(gazetteer)
    shown = ("canonical_name", "category", "subcategory")
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.length(F.concat_ws("", "alias", *shown))), F.lit(0))).first()
    if n > MOST_NAMES or size > MOST_CHARACTERS:
        raise ValueError(f"{n} names of {size} characters are too many for an index: resolve them by joins")
    every = [(r.alias, r.row_pos) for r in listed.select("alias", "row_pos").distinct().collect()]
    known = names.select("alias", "row_pos", "pos").collect()
    place = {pair: k for k, pair in enumerate(every)}

    def prefixes(rows: DataFrame, tokens, shared) -> Iterator:
        """(alias, row_pos, prefix) of each name, its rarest tokens first."""
        ordered = rare_first(rows, ["alias", "row_pos"], tokens, token_counts(rows, tokens), 60 * n)
        return ordered.select("alias", "row_pos", F.slice("tokens", 1, F.greatest(F.size("tokens") - shared + 1, F.lit(0)).cast("int")).alias("prefix")).toLocalIterator()

    grams: dict[str, list[int]] = {}
    pairs = listed.select("alias", "row_pos").distinct()
    for r in prefixes(pairs, trigrams(F.col("alias")), F.ceil(F.size("tokens") * t - _EPS)):
        for token in r.prefix:
            grams.setdefault(token, []).append(place[r.alias, r.row_pos])
    runs: dict[str, list[int]] = {}
    if fuzzy:
        of_name = {r.alias: k for k, r in enumerate(known)}
        gain = 1.5 * t - 1
        paired = 1 / gain if gain > 0 else math.inf  # characters of both texts, beyond which they share two neighbours
        long = F.length("alias")
        least, most = long * 2 / (2 - t), long * 2 / t
        ways = [(1, least <= paired + _EPS, F.ceil(long * t / (2 - t) - _EPS)), (2, most > paired, F.greatest(F.lit(1), F.ceil(least * gain - 1 - _EPS)))]
        for width, fits, shared in ways:
            if width == 2 and math.isinf(paired):
                continue
            for r in prefixes(names.where(fits).select("alias", "row_pos"), _counted(_places(F.col("alias"), width)), shared):
                for token in r.prefix:
                    runs.setdefault(token, []).append(of_name[r.alias])
    heads: dict[str, list] = {}
    for r in known:
        if len(r.alias) >= SHORTEST and "*" not in r.alias and " " not in r.alias:
            heads.setdefault(r.alias[:SHORTEST], []).append((r.pos, r.alias, r.row_pos))
    merchants = listed.groupBy("row_pos").agg(F.min_by(F.struct(*shown), "pos").alias("m")).select("row_pos", "m.*").collect()
    lists = {
        "exact": {r.alias: r.row_pos for r in known}, "heads": heads, "grams": grams, "runs": runs, "listed": every, "names": [(r.alias, r.row_pos) for r in known],
        "merchants": {r.row_pos: tuple(r)[1:] for r in merchants},
    }
    return MerchantIndex(gazetteer.sparkSession.sparkContext.broadcast(lists), threshold, fuzzy)
