"""Data sets for training: label clean-up, corrections, balancing, splits, augmentation, validation.

No step draws random numbers: a row's place is decided by a hash formula of its key, so that a task
that runs again gives the same rows. Ranks within a class come from counts per class and range of
places, and a window over one such range, so that no task sorts a class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgermint.functions.text import variants

#: A formula that any engine can compute, for reproducible order.
HASH_FACTOR, HASH_MOD = 2654435761, 1000003


def place(key: Column, seed: int = 0) -> Column:
    """A pseudo-random whole number of a numeric key."""
    return F.pmod((F.pmod(key, F.lit(HASH_MOD)) + F.lit(seed)) * F.lit(HASH_FACTOR), F.lit(HASH_MOD))


def mapped_labels(df: DataFrame, mapping: DataFrame, first: str = "category", second: str = "label") -> DataFrame:
    """`df` with `new_label` and `label_status` (updated, unchanged, unmapped); mapping is (old, new) with lower-case old names, small."""
    source = F.coalesce(F.col(first), F.col(second))
    m = F.broadcast(mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new")))
    j = df.withColumn("_src", source).join(m, F.lower(F.col("_src")) == F.col("_old"), "left")
    status = F.when(F.col("_new").isNull(), "unmapped").when(F.col("_new") == F.col("_src"), "unchanged").otherwise("updated")
    return j.withColumn("new_label", F.coalesce("_new", "_src")).withColumn("label_status", status).drop("_src", "_old", "_new")


def label_variants(categories: DataFrame) -> DataFrame:
    """(old, new): name, id and their underscore forms, lower-cased, for each (id, name)."""
    name = F.lower("name")
    forms = F.array(name, F.lower("id"), F.regexp_replace(name, " & ", "_"), F.regexp_replace(name, "[^a-z0-9]+", "_"))
    return categories.select(F.explode(F.array_distinct(forms)).alias("old"), F.col("id").alias("new")).groupBy("old").agg(F.min("new").alias("new"))


def merge_corrections(base: DataFrame, corrections: DataFrame, text: str = "text", pos: str = "pos", at: str = "pos") -> DataFrame:
    """`base` (text, label, pos, ...) corrected, with `corrected`: per lower-cased text the last correction (text, label, pos, ...) fixes the first row.

    All columns of `base` but `pos` stay. A corrected row takes the label (also as `category`, where there is one) and
    the subcategory of the last correction, if that has one. Texts that `base` lacks are appended with the label
    and subcategory of their last correction and the text, amount and date of their first. One join gives both, so
    that corrections are derived once, and `base` once for the first rows and once for its own.
    """
    key, given = F.lower(F.trim(F.col(text))), set(corrections.columns)
    firsts_of = [c for c in (text, "amount", "date") if c in given]
    sub = F.nullif(F.col("subcategory"), F.lit("")) if "subcategory" in given else F.lit(None).cast("string")
    c = corrections.withColumn("_s", sub).groupBy(key.alias("_k")).agg(F.max_by(F.struct("label", "_s"), at).alias("_last"), F.min_by(F.struct(*firsts_of), at).alias("_first"))
    # always true: it keeps all columns of `base` here, so that a shuffle that made `base` is read again, not done again for fewer columns
    kept = F.xxhash64(*[n for n, kind in base.dtypes if "map<" not in kind and "variant" not in kind]) >= F.lit(-(2**63))
    firsts = base.where(kept).groupBy(key.alias("_fk")).agg(F.min(pos).alias("_pos"))
    fix = c.join(firsts, F.col("_k") == F.col("_fk"), "left").select("_k", F.col("_fk").isNotNull().alias("_known"), "_pos", "_last", "_first")
    # dealt by place alone, as `base` often is already: texts are compared by their order, as an equality would be a key too; new texts have no place, and are spread by a hash
    place_of = F.coalesce(F.col("_pos").cast("long"), F.xxhash64("_k"))
    same = F.col("_known") & (key <= F.col("_k")) & (key >= F.col("_k"))
    both = base.withColumn("_row", F.lit(True)).join(fix.withColumn("_at", place_of), (F.col(pos).cast("long") == F.col("_at")) & same, "full")
    old = F.col("_row").isNotNull()
    both = both.where(old | ~F.col("_known"))  # of a known text whose rows have no place, none is corrected
    taken = {"label": "_last.label", "category": "_last.label", "subcategory": "_last._s"}
    kinds = dict(base.dtypes)
    made = {n: F.col(f"_first.{n}") for n in firsts_of} | {n: F.col(v) for n, v in taken.items()}
    value = lambda n: F.when(old, F.coalesce(taken[n], n) if n in taken else F.col(n)).otherwise(made.get(n, F.lit(None)).cast(kinds[n])).alias(n)
    return both.select(*[value(n) for n in base.columns if n != pos], F.when(old, F.col("_last").isNotNull()).otherwise(True).alias("corrected"))


def replace_weak(base: DataFrame, improved: DataFrame, weak: list[str], label: str = "label") -> DataFrame:
    """`base` without its weak classes, and the improved rows."""
    return base.where(~F.col(label).isin(*weak)).unionByName(improved, allowMissingColumns=True)


def existing(spark: SparkSession, *paths: str, kind: str = "parquet") -> list[DataFrame]:
    """The sources that are there, in order; missing ones are skipped, other errors are not."""
    found = []
    for path in paths:
        try:
            found.append(spark.read.format(kind).load(path))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def union_sources(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


#: Ranges of places that a class is counted by.
RANGES = 1000


def _ranges(df: DataFrame, label: str, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """`df` with `_place` and `_range`, and (label, _range, _before, _have): rows of the class before the range, and in all."""
    placed = df.withColumn("_place", place(F.col(key), seed)).withColumn("_range", F.floor(F.col("_place") / (HASH_MOD // RANGES + 1)).cast("int"))
    counts = placed.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label)  # at most RANGES rows of a class
    return placed, counts.select(label, "_range", (F.sum("_n").over(w.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_have"))


def ranked(df: DataFrame, label: str = "label", key: str = "txn_key", seed: int = 0, most: int | None = None) -> DataFrame:
    """`df` with `_rank`, from 1 in each class by place, and `_have`, the rows of the class; with `most`, only ranges that begin below it."""
    placed, before = _ranges(df, label, key, seed)
    before = before if most is None else before.where(F.col("_before") < most)
    within = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_place", key))
    joined = placed.join(before.withColumnRenamed("_range", "_r").withColumnRenamed(label, "_l"), F.col(label).eqNullSafe(F.col("_l")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("_rank", F.col("_before") + within).drop("_place", "_range", "_before", "_r", "_l")


def balance(df: DataFrame, n: int, label: str = "label", key: str = "txn_key", seed: int = 0) -> DataFrame:
    """Exactly n rows of each class: n of a large class, repeats of a small one; `copy` counts the repeats. Little more than n rows of a class are sorted."""
    rows = ranked(df, label, key, seed, most=n).where(F.col("_rank") <= n)
    extra = F.floor((F.lit(n) - F.col("_rank")) / F.col("_have")).cast("int")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(extra, F.lit(0))))).drop("_rank", "_have")


def oversample_target(df: DataFrame, label: str = "label", least: int = 100, share: float = 0.8) -> DataFrame:
    """(label, n, target): rows of each class, and what small ones are brought to."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("m"))
    return counts.crossJoin(F.broadcast(top)).select(label, "n", F.greatest(F.lit(least), F.floor(F.col("m") * share)).cast("long").alias("target"))


def split(df: DataFrame, share: float = 0.8, key: str = "txn_key", by: str | None = None, seed: int = 0) -> DataFrame:
    """`df` with `part`, train or validation. Without `by`, about `share` by hash, no shuffle; with it, exactly floor(share * n) of each class."""
    if by is None:
        return df.withColumn("part", F.when(place(F.col(key), seed) < share * HASH_MOD, "train").otherwise("validation"))
    return ranked(df, by, key, seed).withColumn("part", F.when(F.col("_rank") <= F.floor(F.col("_have") * share), "train").otherwise("validation")).drop("_rank", "_have")


def oversample(df: DataFrame, label: str = "label", key: str = "txn_key", text: str = "text", least: int = 100, share: float = 0.8, seed: int = 0) -> DataFrame:
    """`df` with its small classes brought to `oversample_target`: `copy` is 0 for given rows; added ones count from 1 and carry a spelling variant of their text, in turn."""
    targets = oversample_target(df, label, least, share).where("target > n").select(F.col(label).alias("_l"), F.col("target").alias("_target"))
    short = ranked(df.join(F.broadcast(targets), F.col(label).eqNullSafe(F.col("_l"))).drop("_l"), label, key, seed)  # a row per class
    copies = F.floor((F.col("_target") - F.col("_rank")) / F.col("_have")).cast("int")
    added = short.where(copies >= 1).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    spelled = variants(F.col(text))
    added = added.withColumn(text, F.get(spelled, F.pmod(F.col("copy") - 1, F.size(spelled)).cast("int")))
    return df.withColumn("copy", F.lit(0)).unionByName(added.select(*df.columns, "copy"))


def few_shot(df: DataFrame, per_class: int = 2, most: int = 20, label: str = "label", order: str = "pos") -> DataFrame:
    """The first examples of each class, at most `most` in all."""
    w = Window.partitionBy(label).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_class).orderBy(order).limit(most).drop("_n")


def expand_templates(keywords: DataFrame, templates: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(category, text): keyword and template pairs of a category, n of each, in hash order; both tables are dictionaries, joined on category."""
    pairs = keywords.join(templates, "category").withColumn("text", F.replace(F.col("template"), F.lit("{merchant}"), F.col("keyword")))
    order = Window.partitionBy("category").orderBy(F.xxhash64(F.lit(seed), "text"), "text")
    return pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).select("category", "text")


def natural_variants(df: DataFrame, templates: DataFrame, merchant: str = "merchant", label: str = "label", text: str = "text", most: int = 5) -> DataFrame:
    """Spoken forms of a row: templates of its class (or the plain merchant) in three cases, the first `most`, none equal to the text."""
    t = F.broadcast(templates.groupBy(F.col("category").alias("_c")).agg(F.collect_list(F.struct("pos", "template")).alias("_t")))
    listed = F.coalesce(F.transform(F.array_sort("_t"), lambda x: x["template"]), F.array(F.lit("{merchant}")))
    made = F.flatten(F.transform(listed, lambda x: F.transform(F.array(F.col(merchant), F.lower(merchant), F.initcap(merchant)), lambda m: F.replace(x, F.lit("{merchant}"), m))))
    return df.join(t, F.col(label) == F.col("_c"), "left").withColumn("variant", F.explode(F.slice(F.array_distinct(made), 1, most))).where(F.lower("variant") != F.lower(text)).drop("_c", "_t")


# What stands before a merchant in training texts, and classes whose texts name no merchant.
PREFIXES = ("UPI-", "IMPS-", "NEFT-", "RTGS-", "POS PURCHASE ", "ONLINE ORDER ", "FOOD DELIVERY ", "DEBIT CARD ")
NO_MERCHANT = ("Transfers/UPI", "ATM/Cash", "Fees & Charges", "Income/Salary", "Bills", "Rent")


def augmentation_merchant(text: Column) -> Column:
    """The first two words after a known prefix, letters and spaces only; the text where that leaves nothing."""
    rest = F.regexp_replace(text, "^(" + "|".join(PREFIXES) + ")", "")
    words = F.filter(F.split(rest, r"\s+"), lambda w: w != "")
    name = F.trim(F.regexp_replace(F.array_join(F.slice(words, 1, 2), " "), r"[^A-Za-z\s]", ""))
    return F.when(F.size(words) == 0, rest).otherwise(F.coalesce(F.nullif(name, F.lit("")), rest))


def augmented(df: DataFrame, templates: DataFrame, share: float = 0.3, label: str = "label", key: str = "txn_key", text: str = "text", none: tuple[str, ...] = NO_MERCHANT, seed: int = 0) -> DataFrame:
    """`df` and spoken forms of about `share` of its rows whose class names merchants; `augmented` tells them apart."""
    chosen = df.where(~F.col(label).isin(*none) & (place(F.col(key), seed) < share * HASH_MOD)).withColumn("_merchant", augmentation_merchant(F.col(text))).where("length(_merchant) >= 3")
    made = natural_variants(chosen, templates, "_merchant", label, text).withColumn(text, F.col("variant"))
    return df.withColumn("augmented", F.lit(False)).unionByName(made.select(*df.columns, F.lit(True).alias("augmented")))


def augmentation_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, original, added) of augmented rows."""
    return rows.groupBy(label).agg(F.count_if(~F.col("augmented")).alias("original"), F.count_if("augmented").alias("added"))


def class_examples(df: DataFrame, most: int = 5, least: int = 3, label: str = "label", order: str = "pos") -> DataFrame:
    """The first examples of each class with enough of them: `most` a class."""
    enough = df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(F.col(label).alias("_l"))
    w = Window.partitionBy(label).orderBy(order)
    return df.join(F.broadcast(enough), F.col(label) == F.col("_l"), "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def class_weights(df: DataFrame, label: str = "label", ratio: float = 2.0) -> DataFrame:
    """(label, n, weight): balanced weights where the largest class exceeds the smallest `ratio` times, else 1."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_s"), F.count("*").alias("_k"), F.max("n").alias("_max"), F.min("n").alias("_min"))
    weight = F.when(F.col("_max") > ratio * F.col("_min"), F.col("_s") / (F.col("_k") * F.col("n"))).otherwise(1.0)
    return counts.crossJoin(F.broadcast(total)).select(label, "n", F.round(weight, 6).alias("weight"))


def contradictions(df: DataFrame, text: str = "text", label: str = "label", share: float = 0.7) -> DataFrame:
    """Texts with several labels whose top share is below the bound."""
    per = df.groupBy(F.lower(F.trim(text)).alias("key"), label).agg(F.count("*").alias("n"))
    by = per.groupBy("key").agg(F.sum("n").alias("rows"), F.count("*").alias("labels"), F.max("n").alias("top"))
    return by.where((F.col("labels") > 1) & (F.col("top") < share * F.col("rows"))).select("key", "rows", "labels", F.round(F.col("top") / F.col("rows"), 6).alias("top_share"))


def recency_weight(day: Column, today: Column, base: float = 0.99) -> Column:
    return F.pow(F.lit(base), F.datediff(today, day))


def validate(df: DataFrame) -> DataFrame:
    """`df` with `problems`: what is wrong with a training row."""
    t, a = F.trim(F.coalesce("text", F.lit(""))), F.col("amount")
    tests = [(t == "", "empty_text"), (F.length(t) > 500, "long_text"), (F.col("label").isNull(), "no_label"), (a < 0, "negative_amount"), (a > 1e7, "huge_amount"), (F.col("date").try_cast("date").isNull() & F.col("date").isNotNull(), "bad_date")]
    return df.withColumn("problems", F.array_compact(F.array(*[F.when(c, n) for c, n in tests])))


def duplicate_flags(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with `is_duplicate`: other rows share its keys. Counted before joining, so a hot key is no single task."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return df.join(counts, keys, "left").withColumn("is_duplicate", F.col("_n").isNotNull()).drop("_n")
