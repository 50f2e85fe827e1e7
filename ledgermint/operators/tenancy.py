"""Organisations: rows by tenant, cached results by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermint.functions.text import cache_digest


def with_tenant(df: DataFrame, organisations: DataFrame, key: str = "organization_id") -> DataFrame:
    """`df` with org_slug and role: a key without organisation gets org-<id> and member; without a key both are null. `organisations` is (id, slug, role), small."""
    o = F.broadcast(organisations.select(F.col("id").alias("_id"), F.col("slug").alias("_slug"), F.col("role").alias("_role")))
    has = F.col(key).isNotNull()
    return df.join(o, df[key] == F.col("_id"), "left").withColumn("org_slug", F.when(has, F.coalesce("_slug", F.concat(F.lit("org-"), F.col(key).cast("string"))))).withColumn("role", F.when(has, F.coalesce("_role", F.lit("member")))).drop("_id", "_slug", "_role")


def of_tenant(df: DataFrame, organisation: int, key: str = "organization_id") -> DataFrame:
    return df.where(F.col(key) == organisation)


def with_cached(df: DataFrame, cache: DataFrame, parts: tuple[str, ...] = ("text", "amount_cents", "date", "currency")) -> DataFrame:
    """`df` with `cache_key` and the cached category of equal requests, if any; the cache is (cache_key, category).

    Keys are joined as their 32 bytes, half of what their digits take; a cache may hold them so (`cache_digest`).
    """
    given = dict(cache.dtypes)["cache_key"] == "binary"
    kept = cache if given else cache.where(F.col("cache_key") == F.lower(F.hex(F.unhex("cache_key")))).withColumn("cache_key", F.unhex("cache_key"))
    kept = kept.withColumnsRenamed({"cache_key": "_cache_digest", "category": "cached_category"})
    keyed = df.drop("cache_key").withColumn("_digest", cache_digest(*[F.col(p) for p in parts]))
    both = keyed.join(kept, F.col("_digest") == F.col("_cache_digest"), "left")
    return both.select(F.lower(F.hex("_digest")).alias("cache_key"), *[F.col(f"`{c}`") for c in both.columns if c not in ("_digest", "_cache_digest")])
