"""Weighted vote of rule, code, model and external scorers, inside the row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("mcc", "rule", "ml", "llm")


@dataclass(frozen=True)
class Config:
    """Weights, boosts and thresholds of the route and the vote. Weights are divided by their sum."""

    mcc: float = 0.20
    rule: float = 0.20
    ml: float = 0.60
    llm: float = 0.0
    full_boost: float = 0.20
    partial_boost: float = 0.10
    penalty: float = 0.15
    rule_exit: float = 0.95
    mcc_exit: float = 0.90
    merchant_exit: float = 0.70
    merchant_boost: float = 0.10
    merchant_cap: float = 0.95
    text_least: float = 0.70
    name_least: float = 0.80
    auto_accept: float = 0.85
    review: float = 0.60
    low_confidence: float = 0.80

    def weights(self) -> dict[str, float]:
        total = sum(getattr(self, m) for m in METHODS) or 1.0
        return {m: getattr(self, m) / total for m in METHODS}


#: The weights of two other deployments.
SERVICE = Config(mcc=0.25, rule=0.25, ml=0.30, llm=0.20)
COMPOSE = Config(mcc=0.15, rule=0.15, ml=0.40, llm=0.30)

#: Acceptance and review thresholds by category; the rest has the defaults of `Config`.
THRESHOLDS: dict[str, tuple[float, float]] = {
    "investments": (0.90, 0.70), "income_salary": (0.90, 0.70), "rent": (0.90, 0.70), "fees_charges": (0.90, 0.70), "bills": (0.88, 0.65), "transfers_upi": (0.88, 0.65), "fraud_security": (0.95, 0.80),
    "food_dining": (0.80, 0.50), "groceries": (0.80, 0.50), "shopping": (0.80, 0.50), "entertainment": (0.80, 0.50), "transport": (0.80, 0.50), "other": (0.95, 0.80),
}
#: The categories whose thresholds take effect where names and ids are not reconciled first.
COMPAT_THRESHOLDS = ("income_salary", "transfers_upi")


def review_threshold(category: Column, cfg: Config = Config(), compat: bool = False) -> Column:
    out = None
    for c, (_, review) in THRESHOLDS.items():
        if not compat or c in COMPAT_THRESHOLDS:
            out = F.when(category == c, review) if out is None else out.when(category == c, review)
    return out.otherwise(cfg.review)


def wants_external(rule_category: Column, rule_conf: Column, ml_category: Column, ml_conf: Column, cfg: Config = SERVICE, fast_threshold: float | None = None) -> Column:
    """Whether a row goes to the external scorer: nothing known, disagreement, or too little confidence."""
    bound = cfg.low_confidence if fast_threshold is None else fast_threshold
    no_rule, no_ml = rule_category.isNull(), ml_category.isNull()
    low = lambda c: c < bound
    return F.lit(cfg.weights()["llm"] > 0) & F.when(no_rule & no_ml, True).when(~no_rule & ~no_ml, (rule_category != ml_category) | low(rule_conf) | low(ml_conf)).when(no_rule, ml_conf < cfg.low_confidence).otherwise(rule_conf < cfg.low_confidence)


def vote(df: DataFrame, cfg: Config = Config(), compat: bool = False) -> DataFrame:
    """`df` with `vote`, from <method>_category and <method>_conf for each of METHODS (null: no vote) and, if present, ml_alternatives.

    struct<category, confidence, method, agreement, methods, alternatives, ambiguity, requires_review, weighted>.
    A tie goes to the method that comes first. Without any vote: Other, 0, `none`, review.
    """
    w = cfg.weights()
    have = [m for m in METHODS if f"{m}_category" in df.columns]
    cat = {m: F.col(f"{m}_category") for m in have}
    entries = F.filter(F.array(*[F.when(cat[m].isNotNull(), F.struct(F.lit(m).alias("method"), cat[m].alias("category"), (F.col(f"{m}_conf") * w[m]).alias("score"), F.lit(w[m]).alias("weight"), F.lit(i).alias("pos"))) for i, m in enumerate(have)]), lambda e: e.isNotNull())
    work = df.withColumn("_e", entries)
    e = F.col("_e")
    total = lambda c, f: F.aggregate(F.filter(e, lambda x: x["category"] == c), F.lit(0.0), lambda a, x: a + x[f])
    sums = F.transform(F.array_distinct(F.transform(e, lambda x: x["category"])), lambda c, i: F.struct(F.round(total(c, "score"), 9).alias("score"), (-i).alias("order"), c.alias("category")))
    work = work.withColumn("_s", sums)
    s = F.col("_s")
    tie = F.lit(False)
    if {"rule", "ml", "llm"} <= set(have):
        tie = F.lit(w["llm"] > 0) & F.coalesce((cat["rule"] != cat["ml"]) & cat["llm"].isNotNull(), F.lit(False))
    winner = F.when(tie, cat["llm"]).otherwise(F.array_max(s)["category"]) if "llm" in have else F.array_max(s)["category"]
    work = work.withColumn("_w", winner).withColumn("_tie", tie)
    win, tie = F.col("_w"), F.col("_tie")
    voted, methods = F.size(F.filter(e, lambda x: x["category"] == win)), F.size(e)
    weight = total(win, "weight")
    mean = F.when(weight > 0, total(win, "score") / weight).otherwise(total(win, "score"))
    shift = F.when(tie, cfg.partial_boost).when(methods < 2, 0.0).when(voted == methods, cfg.full_boost).when(voted >= 2, cfg.partial_boost).when(voted == 1, -cfg.penalty).otherwise(0.0)
    conf = F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), mean + shift)), 6)
    all_weight = F.aggregate(e, F.lit(0.0), lambda a, x: a + x["weight"])
    pair = lambda c, v: F.struct(F.round(v, 6).alias("score"), c.alias("category"))
    mine = F.filter(F.coalesce(F.col("ml_alternatives"), F.array()), lambda a: a["category"] != win) if "ml_alternatives" in df.columns else F.array().cast("array<struct<category:string,confidence:double>>")
    known = F.transform(mine, lambda a: a["category"])
    lost = F.transform(F.filter(s, lambda x: (x["category"] != win) & ~F.array_contains(known, x["category"])), lambda x: pair(x["category"], F.when(all_weight > 0, x["score"] / all_weight).otherwise(x["score"])))
    alternatives = F.slice(F.reverse(F.array_sort(F.concat(F.transform(mine, lambda a: pair(a["category"], a["confidence"])), lost))), 1, 3)
    method = F.when((voted == methods) & (methods > 1), "ensemble_unanimous").when(methods > 1, F.concat(F.lit("ensemble_"), F.array_join(F.transform(e, lambda x: x["method"]), "+"))).otherwise(F.get(e, F.lit(0))["method"])
    work = work.withColumn("_c", conf).withColumn("_a", alternatives)
    ambiguity = F.when(F.size("_a") > 0, F.round(F.least(F.lit(1.0), F.get("_a", F.lit(0))["score"] / (F.col("_c") + 0.001)), 6)).otherwise(0.0)
    some = methods > 0
    result = F.struct(
        F.when(some, win).otherwise("Other").alias("category"), F.when(some, F.col("_c")).otherwise(0.0).alias("confidence"), F.when(some, method).otherwise("none").alias("method"), voted.alias("agreement"), methods.alias("methods"),
        F.col("_a").alias("alternatives"), ambiguity.alias("ambiguity"), F.when(some, F.col("_c") < review_threshold(win, cfg, compat)).otherwise(True).alias("requires_review"), F.map_from_entries(F.transform(s, lambda x: F.struct(x["category"], x["score"]))).alias("weighted"),
    )
    return work.withColumn("vote", result).drop("_e", "_s", "_w", "_tie", "_c", "_a")
