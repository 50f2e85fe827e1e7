"""Merchant resolution against a gazetteer: exact, substring, trigram and fuzzy name matches.

Names (canonical ones and aliases) are joined, never compared with every text: substrings by the first
characters of a name, similar names by the rarest of what they must share (`operators.similarity`).
Distinct texts are resolved once. The names are
broadcast after a count; beyond `MOST_NAMES` the joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgermint.functions.lineage import materialise
from ledgermint.functions.text import sequence_ratio

from .similarity import jaccard_pairs, sequence_pairs

SUBSTRING_SCORE, SHORTEST = 0.85, 4
#: Names that may be broadcast.
MOST_NAMES = 200_000
#: Keys over which rows without a text are spread.
SPREAD = 4096


def clean_merchant(text: Column) -> Column:
    """Upper case without payment suffixes and marks, single spaces."""
    t = F.upper(F.coalesce(text, F.lit("")))
    # the pattern is searched only where a word that it needs was found
    t = F.when(t.contains("PAY") | t.contains("INTL TRX "), F.regexp_replace(t, r"\*PAYMENT|\*PAY|-PAYMENT|-PAY|INTL TRX ", "")).otherwise(t)
    return F.trim(F.regexp_replace(t, r"[*\-/.\s]+", " "))


def listed_names(gazetteer: DataFrame) -> DataFrame:
    """(row_pos, merchant_id, canonical_name, category, subcategory, alias, pos): the canonical name of each merchant, then its aliases (a list in one string), in order."""
    every = F.concat(F.array("canonical_name"), F.split(F.coalesce("aliases", F.lit("")), ","))
    rows = gazetteer.select("row_pos", "merchant_id", F.upper("canonical_name").alias("canonical_name"), "category", "subcategory", F.posexplode(every).alias("nth", "alias"))
    return rows.withColumn("alias", F.upper(F.trim("alias"))).where("alias <> ''").withColumn("pos", F.col("row_pos") * 1000 + F.col("nth")).drop("nth")


def aliases(gazetteer: DataFrame) -> DataFrame:
    """The names of `listed_names`, each once: in its first place, for the merchant of the last row that lists it."""
    cols = ["row_pos", "merchant_id", "canonical_name", "category", "subcategory"]
    last = listed_names(gazetteer).groupBy("alias").agg(F.max_by(F.struct(*cols), "pos").alias("m"), F.min("pos").alias("pos"))
    return last.select("m.*", "alias", "pos")


def _small(names: DataFrame, n: int) -> DataFrame:
    return F.broadcast(names) if n <= MOST_NAMES else names


def exact_and_substring(texts: DataFrame, names: DataFrame, text: str = "clean", n: int | None = None) -> DataFrame:
    """(text, score, match_type, name columns) of distinct texts: the exact name, else the first name of 4+ characters within a word.

    A name without spaces lies within a word where the text contains it; its first four characters are
    the key of the join. Whole texts and the four-character runs of their words are looked up together, so that
    `texts` is derived once and, where it is dealt by text, not dealt again.
    """
    m = names.select(*[F.col(c).alias(f"m_{c}") for c in names.columns])
    cols = m.columns
    plain = (F.length("m_alias") >= SHORTEST) & ~F.col("m_alias").contains("*") & ~F.col("m_alias").contains(" ")
    keys = m.withColumn("_key", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("way"), F.col("m_alias").alias("key")), F.when(plain, F.struct(F.lit(1).alias("way"), F.substring("m_alias", 1, SHORTEST).alias("key")))))))
    keys = _small(keys.select(F.col("_key.key").alias("_gram"), F.col("_key.way").alias("_way"), *cols), names.count() if n is None else n)
    runs = F.regexp_extract_all(F.col(text), F.lit(f"(?=([^ *]{{{SHORTEST}}}))"), F.lit(1))
    sought = texts.select(text, F.explode_outer(F.concat(F.array(text), runs)).alias("_gram"))  # `explode` would filter on the runs and so search them twice
    holds = F.when(F.col("_way") == 0, F.col(text) == F.col("m_alias")).otherwise(F.col(text).contains(F.col("m_alias")))
    first = F.min_by(F.struct("_way", *cols), F.struct("_way", "m_pos")).alias("m")
    found = sought.join(keys, "_gram").where(holds).groupBy(text).agg(first).select(text, "m.*")
    exact = F.col("_way") == 0
    return found.select(text, *cols, F.when(exact, 1.0).otherwise(SUBSTRING_SCORE).alias("score"), F.when(exact, "exact").otherwise("substring").alias("match_type"))


def trigram_matches(texts: DataFrame, names: DataFrame, threshold: float, text: str = "clean", n: int | None = None) -> DataFrame:
    """(text, row_pos, score): Jaccard similarity of trigram sets, the best name of each merchant; joined by the rarest trigrams of both."""
    n = names.count() if n is None else n
    return jaccard_pairs(texts, names, threshold, text, n).groupBy(text, "row_pos").agg(F.max("score").alias("score"))


def fuzzy_matches(texts: DataFrame, names: DataFrame, threshold: float, text: str = "clean", n: int | None = None) -> DataFrame:
    """(text, row_pos, score): sequence similarity of text and name, of the pairs that may reach the threshold."""
    spark = texts.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = names.count() if n is None else n
    pairs = sequence_pairs(texts, names, threshold, text, n).repartition(tasks)  # few bytes, but costly ones
    scored = pairs.withColumn("score", sequence_ratio(F.col(text), F.col("alias"), threshold))
    # a filter on the score would be moved below the repartition, and the pairs be scored where they were found
    return scored.groupBy(text, "row_pos").agg(F.max("score").alias("score")).where("score IS NOT NULL")


def resolve(df: DataFrame, gazetteer: DataFrame, source: str = "merchant", threshold: float = 0.7, top_k: int = 5, fuzzy: bool = True) -> DataFrame:
    """(clean, rank, merchant columns, score, match_type) for each distinct cleaned name of `source`: the best `top_k` merchants.

    Exact and substring matches end the search; else trigram and fuzzy matches compete, fuzzy first on a tie.
    """
    return resolve_clean(df.select(clean_merchant(F.col(source)).alias("clean")), gazetteer, threshold, top_k, fuzzy)


def resolve_clean(cleaned: DataFrame, gazetteer: DataFrame, threshold: float = 0.7, top_k: int = 5, fuzzy: bool = True) -> DataFrame:
    """`resolve` of a column `clean` that `clean_merchant` has made."""
    listed = materialise(listed_names(gazetteer))
    n = listed.count()
    names = aliases(gazetteer)
    # The distinct names feed every strategy below; written once, they are not derived again for each.
    texts = materialise(cleaned.select("clean").distinct()).where("clean <> ''")
    sure = materialise(exact_and_substring(texts, names, n=n))
    cols = [c for c in sure.columns if c.startswith("m_")]
    open_ = texts.join(sure.select("clean"), "clean", "left_anti")
    found = trigram_matches(open_, listed, threshold, n=n).withColumn("match_type", F.lit("trigram")).withColumn("_way", F.lit(1))
    if fuzzy:
        found = found.unionByName(fuzzy_matches(open_, names, threshold, n=n).withColumn("match_type", F.lit("alias")).withColumn("_way", F.lit(0)))
    best = found.groupBy("clean", "row_pos").agg(F.min_by(F.struct("score", "match_type"), F.struct(-F.col("score"), "_way")).alias("b")).select("clean", "row_pos", "b.*")
    merchants = listed.groupBy("row_pos").agg(F.min_by(F.struct(*listed.columns), "pos").alias("n")).select("n.*")
    rest = best.join(_small(merchants, n), "row_pos").select("clean", *[F.col(c[2:]).alias(c) for c in cols], "score", "match_type")
    ranked = sure.unionByName(rest).where(F.col("score") >= threshold)
    order = Window.partitionBy("clean").orderBy(F.col("score").desc(), F.col("m_row_pos"))
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def search(df: DataFrame, gazetteer: DataFrame, query: str = "query", limit: int = 10) -> DataFrame:
    """The merchants that a search box lists for each query: as `resolve`, from a score of 0.5 on."""
    return resolve(df, gazetteer, query, 0.5, limit)


def attach_merchant(df: DataFrame, gazetteer: DataFrame, source: str = "merchant", threshold: float = 0.8, fuzzy: bool = True, text: str | None = None, text_threshold: float = 0.7) -> DataFrame:
    """`df` with merchant_resolved, merchant_category, merchant_subcategory, merchant_score: the best match of its whole `text` (if given), else of its name in `source`.

    Distinct texts and names are resolved once. Rows whose `source` and `text` are null are matched with nothing.
    The matches, of which there are few where few texts name a merchant, are broadcast after a count; beyond `MOST_NAMES`
    the join shuffles, and rows without a text or name, which have no match, are spread.
    """
    shown = {"m_canonical_name": "merchant_resolved", "m_category": "merchant_category", "m_subcategory": "merchant_subcategory", "score": "merchant_score"}
    ways = ([("_key0", text, text_threshold)] if text else []) + [("_key1", source, threshold)]
    keyed = df.withColumns({key: clean_merchant(F.col(column)) for key, column, _ in ways})
    # texts and names are searched together, once each, with the lower of the two thresholds
    every = keyed.select(F.explode(F.array(*[key for key, _, _ in ways])).alias("clean"))
    found = resolve_clean(every, gazetteer, min(least for _, _, least in ways), 1, fuzzy)
    best = materialise(found.select(F.col("clean").alias("_clean"), F.struct(*[F.col(c).alias(v) for c, v in shown.items()]).alias("_match")))
    n = best.count()
    if n > MOST_NAMES:  # no cleaned text begins with a space
        keyed = keyed.withColumns({key: F.when(F.col(key) == "", F.concat(F.lit(" "), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("string"))).otherwise(F.col(key)) for key, _, _ in ways})
    out, matches = keyed, []
    for key, _, least in ways:
        own = best.where(F.col("_match.merchant_score") >= least).select(F.col("_clean").alias(f"{key}_clean"), F.col("_match").alias(f"{key}_match"))
        out = out.join(_small(own, n), F.col(key) == F.col(f"{key}_clean"), "left")
        matches.append(F.col(f"{key}_match"))
    match = F.coalesce(*matches)
    return out.select(*df.columns, *[match[v].alias(v) for v in shown.values()])
