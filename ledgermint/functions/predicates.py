"""Row predicates as data: one description gives a Spark column and, for checks, SQL of another engine.

A predicate names fields (`lower`, `upper`, `channel`, `amount` ...); the caller says which column
each field is. A few hundred words in dozens of lists are looked for in one pass over the text: a
`WordIndex` turns them into one table of steps, which batches of texts go through in Arrow, and gives the lists
that the text has a word of; a list of words is then a lookup in a short array of numbers. Without an
index, words are looked for one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def searched(pattern: str) -> str:
    """A pattern without .* at its ends, where a search finds it in the same texts: .* in front makes a search start over at every character."""
    return re.sub(r"(?<!\\)(?:\.\*)+$", "", re.sub(r"^(?:\.\*)+", "", pattern))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Predicate:
    def column(self, fields: dict[str, Column]) -> Column:
        raise NotImplementedError

    def sql(self, fields: dict[str, str]) -> str:
        raise NotImplementedError

    def leaves(self) -> Iterator[Predicate]:
        yield self

    def __and__(self, other: Predicate) -> Predicate:
        return _Both((self, other), "AND")

    def __or__(self, other: Predicate) -> Predicate:
        return _Both((self, other), "OR")

    def __invert__(self) -> Predicate:
        return _Not(self)


@dataclass(frozen=True)
class _Both(Predicate):
    parts: tuple[Predicate, ...]
    how: str

    def leaves(self):
        for p in self.parts:
            yield from p.leaves()

    def column(self, fields):
        slow = lambda p: any(isinstance(x, Finds) for x in p.leaves())
        cols = [p.column(fields) for p in sorted(self.parts, key=slow)]  # patterns last: they often need not be tried
        return reduce(lambda a, b: a & b if self.how == "AND" else a | b, cols)

    def sql(self, fields):
        return "(" + f" {self.how} ".join(p.sql(fields) for p in self.parts) + ")"


@dataclass(frozen=True)
class _Not(Predicate):
    part: Predicate

    def leaves(self):
        yield from self.part.leaves()

    def column(self, fields):
        return ~self.part.column(fields)

    def sql(self, fields):
        return f"(NOT {self.part.sql(fields)})"


@dataclass(frozen=True)
class Has(Predicate):
    """The field contains any of the words, as substrings."""

    field: str
    words: tuple[str, ...]

    def column(self, fields):
        index = fields.get(f"index:{self.field}")
        if index is not None and self.words in index.lists:
            return F.array_contains(fields[f"lists:{self.field}"], index.lists[self.words])
        return reduce(lambda a, b: a | b, [fields[self.field].contains(w) for w in self.words])

    def sql(self, fields):
        return "(" + " OR ".join(f"contains({fields[self.field]}, {quoted(w)})" for w in self.words) + ")"


@dataclass(frozen=True)
class Finds(Predicate):
    """Any of the regular expressions is found in the field; `unless` is what must not follow a match.

    `needs` are words of which every text with a match has one; others are not searched. In SQL, whose
    engine has no look-ahead, `unless` excludes the row, which is the same where one match occurs.
    """

    field: str
    patterns: tuple[str, ...]
    unless: str = ""
    needs: tuple[str, ...] = ()

    def leaves(self):
        yield self
        if self.needs:
            yield Has(self.field, self.needs)

    def column(self, fields):
        gate = Has(self.field, self.needs).column(fields) if self.needs and f"index:{self.field}" in fields else None
        look = f"(?!{self.unless})" if self.unless else ""
        test = fields[self.field].rlike("|".join(f"(?:{searched(p) if not look else p}{look})" for p in self.patterns))
        return test if gate is None else gate & test

    def sql(self, fields):
        found = f"regexp_matches({fields[self.field]}, {quoted('|'.join(f'(?:{p})' for p in self.patterns))})"
        if not self.unless:
            return found
        return f"({found} AND NOT regexp_matches({fields[self.field]}, {quoted('|'.join(f'(?:{p}{self.unless})' for p in self.patterns))}))"


@dataclass(frozen=True)
class Is(Predicate):
    """The field is one of the values; null is none."""

    field: str
    values: tuple[str, ...]

    def column(self, fields):
        return F.coalesce(fields[self.field].isin(*self.values), F.lit(False))

    def sql(self, fields):
        return f"coalesce({fields[self.field]} IN ({', '.join(map(quoted, self.values))}), false)"


@dataclass(frozen=True)
class Between(Predicate):
    """low <= field < high; null is not between."""

    field: str
    low: float | None = None
    high: float | None = None

    def column(self, fields):
        c = fields[self.field]
        tests = ([c >= self.low] if self.low is not None else []) + ([c < self.high] if self.high is not None else [])
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))

    def sql(self, fields):
        c = fields[self.field]
        tests = ([f"{c} >= {self.low}"] if self.low is not None else []) + ([f"{c} < {self.high}"] if self.high is not None else [])
        return f"coalesce({' AND '.join(tests)}, false)"


@dataclass(frozen=True)
class Equals(Predicate):
    """The field is a number; null is not."""

    field: str
    value: float

    def column(self, fields):
        return F.coalesce(fields[self.field] == self.value, F.lit(False))

    def sql(self, fields):
        return f"coalesce({fields[self.field]} = {self.value}, false)"


#: Bytes of a text that are stepped through at once; a longer text is cut into pieces that overlap by the longest word.
PIECE = 256
#: Pieces that are stepped through together; bounds the memory of a Python worker.
TOGETHER = 1 << 16


class WordIndex:
    """Lists of ASCII words, by number, that one pass over a text looks for as substrings.

    The words are a tree of characters whose every place knows, for each next character, the place of the longest
    beginning of a word that ends there (Aho-Corasick). All texts of a batch take a step together.
    """

    def __init__(self, lists: list[tuple[str, ...]]):
        self.lists = {words: i for i, words in enumerate(dict.fromkeys(lists))}
        of: dict[str, set[int]] = {}
        for words, i in self.lists.items():
            for w in words:
                of.setdefault(w, set()).add(i)
        self.longest = max(map(len, of), default=1)
        letters = sorted(set("".join(of)))
        self.code_of = np.zeros(256, np.intp)  # 0: in no word
        self.code_of[[ord(c) for c in letters]] = range(1, len(letters) + 1)
        tree, ends = [{}], [set()]
        for w, numbers in of.items():
            at = 0
            for c in w.encode("ascii"):
                if c not in tree[at]:
                    tree[at][c] = len(tree)
                    tree.append({})
                    ends.append(set())
                at = tree[at][c]
            ends[at] |= numbers
        step, shorter, places = np.zeros((len(tree), len(letters) + 1), np.intp), [0] * len(tree), [0]
        for at in places:  # grows: a place comes after all shorter beginnings
            ends[at] = ends[at] | ends[shorter[at]]
            step[at] = step[shorter[at]]
            for c, below in tree[at].items():
                shorter[below] = int(step[at, self.code_of[c]]) if at else 0
                step[at, self.code_of[c]] = below
                places.append(below)
        self.step = step.astype(np.int32)
        self.numbers = np.array([i for found in ends for i in sorted(found)], np.int32)
        self.begin = np.cumsum([0, *map(len, ends)])

    def numbers_in(self, texts: pa.Array) -> pa.Array:
        """The numbers of the lists that have a word in each text, ascending; null for a null text."""
        plain = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
        _, offsets, data = plain.buffers()
        at = np.frombuffer(offsets, np.int64)[plain.offset : plain.offset + len(plain) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        apart, size = max(1, PIECE - self.longest + 1), np.diff(at)
        pieces = np.maximum(1, -(-(size - self.longest + 1) // apart))
        row = np.repeat(np.arange(len(plain)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, end = at[row] + nth * apart, at[row + 1]
        length = np.minimum(end - begin, apart + self.longest - 1)
        found = [np.empty(0, np.int64)]
        for a in range(0, len(row), TOGETHER):
            order = a + np.argsort(-length[a : a + TOGETHER], kind="stable")
            first, left = begin[order], np.searchsorted(-length[order], -np.arange(length[order[0]]), "left")
            place = np.zeros(len(order), np.intp)
            for i, n in enumerate(left):  # the n pieces that are longer than i
                place[:n] = self.step[place[:n], self.code_of[data[first[:n] + i]]]
                hit = np.flatnonzero(self.begin[place[:n] + 1] > self.begin[place[:n]])
                if len(hit):
                    some = self.begin[place[hit] + 1] - self.begin[place[hit]]
                    which = np.repeat(self.begin[place[hit]] - np.cumsum(some) + some, some) + np.arange(some.sum())
                    found.append(np.repeat(row[order[hit]], some) * len(self.lists) + self.numbers[which])
        each = np.unique(np.concatenate(found))
        cuts = np.searchsorted(each, np.arange(len(plain) + 1) * max(1, len(self.lists)))
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(each % max(1, len(self.lists)), pa.int32()))
        return pc.if_else(pc.is_valid(texts), lists, pa.scalar(None, lists.type)) if texts.null_count else lists

    def found(self, text: Column) -> Column:
        """The numbers of the lists that have a word in the text; null for a null text."""

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def lists_of(texts: pa.Array) -> pa.Array:
            return self.numbers_in(texts)

        return lists_of(text)


def indexed(predicates: list[Predicate], field: str) -> WordIndex:
    """An index of the lists of words that predicates look for in a field."""
    return WordIndex([x.words for p in predicates for x in p.leaves() if isinstance(x, Has) and x.field == field])


def with_index(df: DataFrame, fields: dict, indexes: dict[str, WordIndex]) -> tuple[DataFrame, dict]:
    """`df` with a column `_lists_<field>` for each index, and the fields with the indexes."""
    more = dict(fields)
    for field, index in indexes.items():
        df = df.withColumn(f"_lists_{field}", index.found(fields[field]))
        more |= {f"index:{field}": index, f"lists:{field}": F.col(f"_lists_{field}")}
    return df, more


def first_of_sql(fields: dict[str, str], choices: list[tuple[Predicate, str]], default: str | None) -> str:
    last = "NULL" if default is None else quoted(default)
    return last if not choices else "CASE " + " ".join(f"WHEN {p.sql(fields)} THEN {quoted(v)}" for p, v in choices) + f" ELSE {last} END"
