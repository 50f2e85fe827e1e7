"""Similarity joins of short texts and names that compare only pairs which share something rare.

A text is a set of tokens, put in one order for both sides: the rarest among the names first. Where two sets must
share c tokens, of n tokens one of the first n - c + 1 is shared too (the prefix), so that only prefixes are keys of
the join, and common tokens hardly ever are. A pair is kept at its first shared key alone, so none appears twice.

* `jaccard_pairs`: sets of trigrams. A similarity of t or more means t * n shared trigrams at least.
* `sequence_pairs`: sequence similarity 2M / L of M matched characters of L in both texts. M characters in blocks: two
  blocks have an unmatched character between them, so that there are L - 2M + 1 blocks at most and
  3M - L - 1 pairs of neighbours are shared at least. Where that is none (short pairs), tokens are characters, of
  which M are shared. Deleting and inserting what is unmatched leads from one text to the other, so the edit distance,
  which Spark computes in the row, is L - 2M at most.

No pair that reaches the threshold is left out. The names are broadcast within a bound of rows, else shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermint.functions.text import bound, trigrams

#: Rows of keys of names that may be broadcast (about half a kilobyte each).
MOST_KEYS = 200_000
_EPS = 1e-9


def small(rows: DataFrame, n: int) -> DataFrame:
    """`rows`, broadcast where there are at most `MOST_KEYS`."""
    return F.broadcast(rows) if n <= MOST_KEYS else rows


def _places(text: Column, width: int) -> Column:
    """The runs of `width` characters of a text; none of a shorter one."""
    last = F.length(text) - (width - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def _counted(items: Column) -> Column:
    """Each item with how often it has occurred so far, which makes a multiset a set."""
    nth = lambda every, x, i: F.size(F.filter(F.slice(every, 1, i + 1), lambda y: y == x)).cast("string")
    numbered = lambda every: F.transform(every, lambda x, i: F.concat(x, F.lit("\x1f"), nth(every, x, i)))
    once = lambda every: F.transform(every, lambda x: F.concat(x, F.lit("\x1f1")))
    return bound(items, lambda every: F.when(F.size(F.array_distinct(every)) == F.size(every), once(every)).otherwise(numbered(every)))


def token_counts(names: DataFrame, tokens: Column) -> DataFrame:
    """(token, n): in how many names a token occurs."""
    return names.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def rare_first(rows: DataFrame, keys: list[str], tokens: Column, counts: DataFrame, n: int) -> DataFrame:
    """(keys, size, tokens): how many tokens each row has, and those of them that `counts` lists, the rarest first; `n` bounds the rows of `counts`.

    Tokens that no name has would come first and match nothing, so they are left out as soon as they are counted; rows
    without any other are left out too. Rows are dealt by their keys once, over all tasks: they are few bytes, but what follows costs time.
    """
    spark = rows.sparkSession
    # not `explode`: it would add a filter on the tokens, which are then made anew for it, before the rows are dealt; the join drops nulls
    # twice the usual number, else a deal by the same keys below would stand for this one and small bytes be one task's work
    tasks = 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = rows.repartition(tasks, *keys).select(*keys, tokens.alias("_tokens")).select(*keys, F.size("_tokens").alias("size"), F.explode_outer("_tokens").alias("token")).join(small(counts, n), "token")
    sorted_ = F.array_sort(F.collect_list(F.struct("n", "token")))
    # the size is no key: filters on keys are moved before the deal too
    return each.groupBy(*keys).agg(F.max("size").alias("size"), F.transform(sorted_, lambda x: x["token"]).alias("tokens"))


def _joined(left: DataFrame, right: DataFrame, n: int, fits: Column) -> DataFrame:
    """Pairs that fit and share a token of their prefixes, at the first of these; (tokens, prefix, size) of the left side are named _a, _pa, _na, of the right side _b, _pb, _nb.

    `fits` compares sizes; it is tried first, since it costs least.
    """
    a = left.withColumnsRenamed({"tokens": "_a", "prefix": "_pa", "size": "_na"}).withColumn("_key", F.explode_outer("_pa"))
    b = right.withColumnsRenamed({"tokens": "_b", "prefix": "_pb", "size": "_nb"}).withColumn("_key", F.explode_outer("_pb"))
    return a.join(small(b, n), "_key").where(fits).where(F.get(F.array_intersect("_pa", "_pb"), F.lit(0)) == F.col("_key"))


def _with_prefix(ordered: DataFrame, shared: Column) -> DataFrame:
    """`ordered` with the tokens of which a match that shares `shared` tokens has one; rows with fewer tokens that names have match nothing and go.

    The first `size` - `shared` + 1 of all tokens begin with those that no name has, and these are not listed.
    """
    return ordered.where(F.size("tokens") >= shared).withColumn("prefix", F.slice("tokens", 1, (F.size("tokens") - shared + 1).cast("int")))


def jaccard_pairs(texts: DataFrame, names: DataFrame, threshold: float, text: str, n: int) -> DataFrame:
    """(text, alias, row_pos, score): pairs whose trigram sets have a Jaccard similarity of `threshold` or more. `names` has `n` rows of (alias, row_pos)."""
    names = names.select("alias", "row_pos").distinct()
    counts = token_counts(names, trigrams(F.col("alias")))
    shared = F.greatest(F.lit(1), F.ceil(F.col("size") * threshold - _EPS))
    largest = names.agg(F.max(F.size(trigrams(F.col("alias"))))).first()[0] or 0
    # not a filter, which would be moved before the texts are dealt over all tasks
    fitting = bound(trigrams(F.col(text)), lambda x: F.when(F.size(x) * threshold <= largest + _EPS, x))
    left = _with_prefix(rare_first(texts.select(text), [text], fitting, counts, 20 * n), shared)
    right = _with_prefix(rare_first(names, ["alias", "row_pos"], trigrams(F.col("alias")), counts, 20 * n), shared)
    na, nb = F.col("_na"), F.col("_nb")
    near = _joined(left, right, 20 * n, F.least(na, nb) >= threshold * F.greatest(na, nb) - _EPS)
    common = F.size(F.array_intersect("_a", "_b"))
    return near.withColumn("score", common / (na + nb - common)).where(F.col("score") >= threshold).select(text, "alias", "row_pos", "score")


def sequence_pairs(texts: DataFrame, names: DataFrame, threshold: float, text: str, n: int) -> DataFrame:
    """(text, alias, row_pos): pairs that may have a sequence similarity of `threshold` or more, none of which is left out."""
    t = threshold
    names = names.select("alias", "row_pos").distinct()
    longest = names.agg(F.max(F.length("alias"))).first()[0] or 0
    texts = texts.where((F.length(text) > 0) & (F.length(text) * t <= longest * (2 - t) + _EPS)).select(text)
    gain = 1.5 * t - 1
    paired = 1 / gain if gain > 0 else math.inf  # longer pairs share two neighbours
    found = None
    for width in (1, 2):
        def side(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
            size = F.length(column)
            least, most = size * 2 / (2 - t), size * 2 / t  # characters of both texts
            if width == 1:
                rows = rows.where(least <= paired + _EPS)
                shared = F.greatest(F.lit(1), F.ceil(size * t / (2 - t) - _EPS))
            else:
                rows = rows.where(most > paired)
                shared = F.greatest(F.lit(1), F.ceil(least * gain - 1 - _EPS))
            items = _counted(_places(F.col(column), width))
            return _with_prefix(rare_first(rows, keys, items, counts, 60 * n), shared)

        if width == 2 and math.isinf(paired):
            continue
        counts = token_counts(names, _counted(_places(F.col("alias"), width)))
        both = F.length(text) + F.length("alias")
        fits = (2 * F.least(F.length(text), F.length("alias")) >= t * both - _EPS) & ((both <= paired + _EPS) if width == 1 else (both > paired + _EPS))
        least = F.ceil(t * both / 2 - _EPS) if width == 1 else F.ceil(both * gain - 1 - _EPS)
        near = _joined(side(texts, [text], text), side(names, ["alias", "row_pos"], "alias"), 20 * n, fits).where(F.size(F.array_intersect("_a", "_b")) >= least)
        near = near.where(F.levenshtein(text, "alias") <= (1 - t) * both + _EPS)
        if width == 2:  # matched characters are shared ones
            chars = lambda column: _counted(_places(F.col(column), 1))
            near = near.where(F.size(F.array_intersect(chars(text), chars("alias"))) >= F.ceil(t * both / 2 - _EPS))
        near = near.select(text, "alias", "row_pos")
        found = near if found is None else found.unionByName(near)
    return found
