"""Benchmark decontamination with DataFrame functions alone.

An item is cut into windows of ten words (an item of fewer is one window). A document word inside
any occurrence of a window is hit. Three steps:

1. Scan. Every occurrence of a window of k words holds, at a multiple of g = (k + 1) // 2, a whole
   g-gram of that window. So only the g-grams at those places of a document are looked up, in a
   broadcast hash set of all g-grams of the windows. This can miss nothing and costs one lookup
   for five words. Its words are fully lower-cased, which is coarser than A-Z alone.
2. Verify. Documents with a looked-up gram are cut into all their windows, which are joined to the
   item windows by their very words.
3. Merge. Window places become hit words, and items are listed.

The grams and windows of the benchmark are broadcast only while their number is within
`common.BROADCAST_ROWS`; beyond that they are joined by shuffle, where Spark splits skewed partitions.

Null texts have no words. Repeated rows get equal results. Items without id make words hit but are
not listed. With an empty benchmark or empty documents nothing is hit.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise, table

WINDOW = 10
#: Words are runs of digits, a-z and characters beyond ASCII, in lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def lower_coarse(text: Column) -> Column:
    """Fully lower-cased, with one sigma: texts equal under `lower_ascii` stay equal."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def words(text: Column) -> Column:
    """The words of lower-cased text, in order; of null, none."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATORS)
    head = (parts[0] == "").cast("int")
    tail = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.slice(parts, head + 1, F.greatest(F.size(parts) - head - tail, F.lit(0)))


def grams(w: Column, size: int, step: int) -> Column:
    """Hashes of the runs of `size` words at each multiple of `step`."""
    n = F.size(w) - size
    places = F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(size), F.slice(w, i + 1, F.lit(size))))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, lowered=lower_ascii) -> DataFrame:
    """(id, k, window): each window of each item as an array of k words."""
    w = benchmark.select(F.col(id_col).alias("id"), words(lowered(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(window))
    return w.select("id", k.alias("k"), F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.slice("w", i + 1, k))).alias("window"))


def places_of(w: Column, k: int) -> Column:
    """array<struct<at, k, key>>: every run of k words, joined by spaces, and its place."""
    all_places = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(all_places, lambda i: F.struct(i.alias("at"), F.lit(k).alias("k"), F.array_join(F.slice(w, i + 1, F.lit(k)), " ").alias("key")))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, text_hash, n_words, hits, items) of each row: places of its hit words, and ids of the items found.

    `text_hash` is xxhash64 of the text; both arrays are in order, and empty where nothing is hit.
    """
    items = materialise(item_windows(benchmark, item_col, item_text_col, window).groupBy("k", "window").agg(F.collect_set("id").alias("items")))
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most `window` values
    text, doc = F.col(text_col), [F.col(id_col), F.xxhash64(F.col(text_col)).alias("text_hash")]
    if not lengths:
        none = [F.array().cast("array<int>").alias("hits"), F.array().cast(f"array<{dict(benchmark.dtypes)[item_col]}>").alias("items")]
        return docs.select(*doc, F.size(words(lower_coarse(text))).cast("long").alias("n_words"), *none)

    sizes = sorted({(k + 1) // 2 for k in lengths})
    coarse = item_windows(benchmark, item_col, item_text_col, window, lower_coarse)
    gram_size = F.floor((F.col("k") + 1) / 2)
    of_size = F.coalesce(*[F.when(gram_size == g, grams(F.col("window"), g, 1)) for g in sizes])
    known = materialise(coarse.select(F.explode(of_size).alias("gram")).distinct())
    split = docs.select(*doc, F.monotonically_increasing_id().alias("row"), words(lower_coarse(text)).alias("w"))
    looked_up = split.select(id_col, "text_hash", "row", F.size("w").cast("long").alias("n_words"), F.explode_outer(F.concat(*[grams(F.col("w"), g, g) for g in sizes])).alias("gram"))
    scanned = looked_up.join(bounded(known.withColumn("found", F.lit(True)), known.count()), "gram", "left")
    base = materialise(scanned.groupBy("row", id_col, "text_hash", "n_words").agg(F.max("found").alias("found")))

    suspects = base.where("found").select(F.col(id_col).alias("sid"), F.col("text_hash").alias("shash")).distinct()
    whole = docs.select(*doc, text.alias("text")).join(bounded(suspects, suspects.count()), (F.col(id_col).eqNullSafe(F.col("sid"))) & (F.col("text_hash") == F.col("shash")), "left_semi")
    cut = whole.select(id_col, "text_hash", words(lower_ascii(F.col("text"))).alias("w"))
    places = cut.select(id_col, "text_hash", F.explode(F.concat(*[places_of(F.col("w"), k) for k in lengths])).alias("p")).select(id_col, "text_hash", "p.at", "p.k", "p.key")
    wanted = items.select(F.array_join("window", " ").alias("key"), "items")
    hits = places.join(bounded(wanted, wanted.count()), "key").groupBy(id_col, "text_hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("k") - 1))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    hits = hits.select(F.col(id_col).alias("hid"), F.col("text_hash").alias("hhash"), "hits", "items")
    kinds = dict(hits.dtypes)
    return base.join(hits, F.col(id_col).eqNullSafe(F.col("hid")) & (F.col("text_hash") == F.col("hhash")), "left").select(
        id_col, "text_hash", "n_words", *[F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("hits", "items")])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the rows that hold an item window; the other rows keep all their columns."""
    found = find_contamination(docs, benchmark, id_col, text_col, **options).where(F.size("hits") > 0)
    found = found.select(F.col(id_col).alias("_cid"), F.col("text_hash").alias("_chash")).distinct()
    found = materialise(found)
    return docs.join(bounded(found), F.col(id_col).eqNullSafe(F.col("_cid")) & (F.xxhash64(F.col(text_col)) == F.col("_chash")), "left_anti")


def remove_spans(text: Column, hits: Column) -> Column:
    """`text` without its hit words; what stands between words stays."""
    tokens = F.regexp_extract_all(text, F.lit(r"([0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    first = F.when(F.element_at(tokens, 1).rlike(r"^[0-9A-Za-z\x{80}-\x{10FFFF}]"), 0).otherwise(1)
    kept = F.filter(tokens, lambda t, i: ~((F.pmod(i - first, F.lit(2)) == 0) & F.array_contains(hits, F.floor((i - first) / 2).cast("int"))))
    return F.when(F.size(hits) > 0, F.array_join(kept, "")).otherwise(text)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of every whole text of `documents` against `benchmark`."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_LOWER_SQL = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS_SQL = f"list_filter(string_split_regex({_LOWER_SQL.format("coalesce(text, '')")}, '{SEPARATORS}'), lambda x: x <> '')"
ORACLE_SQL = f"""
with d as (select doc_id, {_WORDS_SQL} as w from documents),
b as (select item_id, {_WORDS_SQL} as w from benchmark),
bk as (select item_id, w, least(len(w), {WINDOW}) as k from b where len(w) > 0),
bw as (select distinct item_id, k, list_slice(w, i, i + k - 1) as win from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from bk)),
ks as (select distinct k from bw),
dw as (select doc_id, k, i, list_slice(w, i, i + k - 1) as win from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
h as (select dw.doc_id, dw.i, dw.k, bw.item_id from dw join bw on dw.k = bw.k and dw.win = bw.win),
hw as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + k)) as p from (select distinct doc_id, i, k from h)) group by 1),
hi as (select doc_id, count(*) as n, string_agg(t, ',' order by t) as ids from (select distinct doc_id, cast(item_id as varchar) as t from h) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(hw.n, 0) as bigint) as n_hit, cast(coalesce(hi.n, 0) as bigint) as n_items,
  sha256(coalesce(hi.ids, '')) as items_sha256, coalesce(hw.n, 0) > 0 as contaminated
from d left join hw on d.doc_id = hw.doc_id left join hi on d.doc_id = hi.doc_id
"""
