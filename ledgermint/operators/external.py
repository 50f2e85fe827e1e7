"""Tables for an external language-model scorer: requests, and responses parsed into votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermint.functions.text import embedded_json

from .merchant_codes import category_id

DEFAULT_CONFIDENCE = 0.5


def requests(df: DataFrame, examples: list[tuple[str, str]], categories: list[str], text: str = "text") -> DataFrame:
    """(request_key, prompt) of each distinct text: what to send to a scorer, once."""
    shown = "\n".join(f"Transaction: {t} -> {c}" for t, c in examples[:5])
    prompt = F.concat(F.lit(f"Choose one category of: {', '.join(categories)}.\n{shown}\nTransaction: "), F.col(text), F.lit('\nAnswer as JSON: {"category": ..., "confidence": ..., "reasoning": ...}'))
    return df.select(F.md5(F.lower(F.trim(text))).alias("request_key"), prompt.alias("prompt")).dropDuplicates(["request_key"])


def responses(raw: DataFrame, categories: list[str], key: str = "request_key", body: str = "body") -> DataFrame:
    """(request_key, llm_category, llm_conf, llm_reasoning) from answers that hold JSON somewhere; what cannot be read is Other at 0.5."""
    m = F.from_json(embedded_json(F.col(body)), "category string, confidence double, reasoning string")
    parsed = raw.select(key, m.alias("m")).withColumn("_c", category_id(F.col("m.category")))
    known = F.col("_c").isin(*categories)
    conf = F.when((F.col("m.confidence") >= 0) & (F.col("m.confidence") <= 1), F.col("m.confidence"))
    return parsed.select(key, F.when(known, F.col("_c")).otherwise("Other").alias("llm_category"), F.when(known, F.coalesce(conf, F.lit(DEFAULT_CONFIDENCE))).otherwise(DEFAULT_CONFIDENCE).alias("llm_conf"), F.substring("m.reasoning", 1, 100).alias("llm_reasoning"))


def attach_responses(df: DataFrame, answers: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("request_key", F.md5(F.lower(F.trim(text)))).join(answers, "request_key", "left").drop("request_key")
