"""Merchant category codes: the code map, codes named in texts, and classification by code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermint.functions.text import found

HIGH_CONFIDENCE, OTHER_CONFIDENCE = 0.95, 0.85
# The category of each code, and the codes that are very specific.
CODES: dict[str, str] = {
    "5812": "food_dining",
    "5814": "food_dining",
    "5813": "food_dining",
    "5811": "food_dining",
    "5411": "groceries",
    "5422": "groceries",
    "5451": "groceries",
    "5462": "groceries",
    "5499": "groceries",
    "4111": "transport",
    "4112": "transport",
    "4119": "transport",
    "4121": "transport",
    "4131": "transport",
    "4784": "transport",
    "4789": "transport",
    "7511": "transport",
    "7523": "transport",
    "7549": "transport",
    "3000": "travel",
    "3001": "travel",
    "3002": "travel",
    "3003": "travel",
    "3004": "travel",
    "3005": "travel",
    "3006": "travel",
    "3007": "travel",
    "3008": "travel",
    "3009": "travel",
    "3010": "travel",
    "3050": "travel",
    "3298": "travel",
    "4411": "travel",
    "4511": "travel",
    "4722": "travel",
    "7011": "travel",
    "7012": "travel",
    "7032": "travel",
    "7033": "travel",
    "5541": "fuel",
    "5542": "fuel",
    "5983": "fuel",
    "4816": "utilities",
    "4821": "utilities",
    "4814": "bills",
    "4899": "bills",
    "4900": "bills",
    "6513": "rent",
    "5200": "shopping",
    "5211": "shopping",
    "5231": "shopping",
    "5251": "shopping",
    "5261": "shopping",
    "5271": "shopping",
    "5300": "shopping",
    "5311": "shopping",
    "5331": "shopping",
    "5399": "shopping",
    "5611": "shopping",
    "5621": "shopping",
    "5631": "shopping",
    "5641": "shopping",
    "5651": "shopping",
    "5655": "shopping",
    "5661": "shopping",
    "5681": "shopping",
    "5691": "shopping",
    "5697": "shopping",
    "5698": "shopping",
    "5699": "shopping",
    "5712": "shopping",
    "5713": "shopping",
    "5714": "shopping",
    "5718": "shopping",
    "5719": "shopping",
    "5722": "shopping",
    "5732": "shopping",
    "5733": "shopping",
    "5734": "shopping",
    "5735": "shopping",
    "5815": "shopping",
    "5921": "shopping",
    "5931": "shopping",
    "5932": "shopping",
    "5933": "shopping",
    "5935": "shopping",
    "5937": "shopping",
    "5940": "shopping",
    "5941": "shopping",
    "5942": "shopping",
    "5943": "shopping",
    "5944": "shopping",
    "5945": "shopping",
    "5946": "shopping",
    "5947": "shopping",
    "5948": "shopping",
    "5949": "shopping",
    "5950": "shopping",
    "5960": "shopping",
    "5970": "shopping",
    "5971": "shopping",
    "5972": "shopping",
    "5973": "shopping",
    "5977": "shopping",
    "5978": "shopping",
    "5992": "shopping",
    "5993": "shopping",
    "5994": "shopping",
    "5995": "shopping",
    "5996": "shopping",
    "5997": "shopping",
    "5998": "shopping",
    "5999": "shopping",
    "7230": "shopping",
    "7261": "shopping",
    "7273": "shopping",
    "7276": "shopping",
    "7277": "shopping",
    "7278": "shopping",
    "7296": "shopping",
    "7297": "shopping",
    "7298": "shopping",
    "5511": "shopping",
    "5521": "shopping",
    "5531": "shopping",
    "5532": "shopping",
    "5533": "shopping",
    "5571": "shopping",
    "7531": "shopping",
    "7534": "shopping",
    "7535": "shopping",
    "7538": "shopping",
    "7542": "shopping",
    "7832": "entertainment",
    "7841": "entertainment",
    "7922": "entertainment",
    "7929": "entertainment",
    "7932": "entertainment",
    "7933": "entertainment",
    "7991": "entertainment",
    "7992": "entertainment",
    "7993": "entertainment",
    "7994": "entertainment",
    "7995": "entertainment",
    "7996": "entertainment",
    "7997": "entertainment",
    "7998": "entertainment",
    "7999": "entertainment",
    "5816": "entertainment",
    "5912": "health",
    "5975": "health",
    "5976": "health",
    "8011": "health",
    "8021": "health",
    "8031": "health",
    "8041": "health",
    "8042": "health",
    "8043": "health",
    "8049": "health",
    "8050": "health",
    "8062": "health",
    "8071": "health",
    "8099": "health",
    "8211": "education",
    "8220": "education",
    "8241": "education",
    "8244": "education",
    "8249": "education",
    "8299": "education",
    "5192": "education",
    "6012": "fees_charges",
    "6051": "fees_charges",
    "6540": "fees_charges",
    "9211": "fees_charges",
    "9222": "fees_charges",
    "9223": "fees_charges",
    "9311": "fees_charges",
    "6538": "income_salary",
    "6536": "transfers_upi",
    "6537": "transfers_upi",
    "4829": "transfers_upi",
    "6010": "atm_cash",
    "6011": "atm_cash",
    "6050": "atm_cash",
    "6211": "investments",
    "6300": "investments",
    "6381": "investments",
    "6399": "investments",
}
HIGH_CODES = (
    "3000", "3001", "3002", "3003", "3004", "3005", "3006", "3007", "3008", "3009", "3010", "3050", "3298", "4511",
    "5541", "5542", "5983", "4900", "8011", "8021", "8031", "8041", "8042", "8043", "8049", "8050", "8062", "8071",
    "8099", "8211", "8220", "8241", "8244", "8249", "8299", "5812", "5814", "5813", "5811", "5411", "5422", "5451",
    "5462", "5499", "4111", "4112", "4121", "4131", "4784", "4789", "6011", "7011", "7012",
)
#: Where a text may name a code, in order.
IN_TEXT = [r"[/\s](\d{4})[/\s]", r"(?i)MCC[:\s]*(\d{4})", r"\((\d{4})\)", r"^(\d{4})[/\s]"]


def code_rows(codes: dict[str, str] = CODES, high: tuple[str, ...] = HIGH_CODES) -> list[tuple[str, str, bool]]:
    return [(c, category, c in high) for c, category in sorted(codes.items())]


def code_table(spark: SparkSession, rows: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """(mcc, category, high): the code map as a small table."""
    return spark.createDataFrame(code_rows() if rows is None else rows, "mcc string, category string, high boolean")


def code_in_text(text: Column, known: list[str] | None = None) -> Column:
    """The first known code that a text names; an unknown one makes way for the next pattern."""
    known = [c for c, _, _ in code_rows()] if known is None else known
    tries = [found(text, p) for p in IN_TEXT]
    return F.coalesce(*[F.when(t.isin(*known), t) for t in tries])


def classify_codes(df: DataFrame, codes: DataFrame, mcc: str = "mcc") -> DataFrame:
    """`df` with mcc_category and mcc_conf; an unknown code is Other with 0, no code is null. `codes` has about 200 rows."""
    dim = F.broadcast(codes.select(F.col("mcc").alias("_code"), F.col("category").alias("_cat"), "high"))
    joined = df.join(dim, df[mcc] == F.col("_code"), "left")
    none = F.col(mcc).isNull()
    conf = F.when(none, F.lit(None)).when(F.col("_code").isNull(), 0.0).when(F.col("high"), HIGH_CONFIDENCE).otherwise(OTHER_CONFIDENCE)
    return joined.withColumn("mcc_category", F.when(none, F.lit(None)).otherwise(F.coalesce("_cat", F.lit("Other")))).withColumn("mcc_conf", conf.cast("double")).drop("_code", "_cat", "high")


def reconcile_codes(codes: DataFrame, taxonomy_codes: DataFrame) -> DataFrame:
    """Full outer comparison of two code maps (mcc, category): one row per code, with `agrees`."""
    a, b = codes.select("mcc", F.col("category").alias("map_category")), taxonomy_codes.select("mcc", F.col("category").alias("taxonomy_category"))
    return a.join(b, "mcc", "full_outer").withColumn("agrees", F.col("map_category").eqNullSafe(F.col("taxonomy_category")))


#: The ids of category names, in lower case.
CATEGORY_NAMES = {
    "food & dining": "food_dining",
    "groceries": "groceries",
    "transport": "transport",
    "travel": "travel",
    "fuel": "fuel",
    "rent": "rent",
    "shopping": "shopping",
    "entertainment": "entertainment",
    "health": "health",
    "education": "education",
    "fees & charges": "fees_charges",
    "income/salary": "income_salary",
    "transfers/upi": "transfers_upi",
    "atm/cash": "atm_cash",
    "investments": "investments",
    "bills": "bills",
    "fraud & security": "fraud_security",
    "insurance": "insurance",
    "personal care": "personal_care",
    "pets": "pets",
    "home improvement": "home_improvement",
    "automotive": "automotive",
    "professional services": "professional_services",
    "other": "other",
    "charity & donations": "charity_donations",
    "taxes & government": "taxes_government",
    "electronics & technology": "electronics_technology",
    "kids & family": "kids_family",
    "subscriptions & memberships": "subscriptions_memberships",
    "gifts & special occasions": "gifts_occasions",
    "utilities": "bills",
    "utility": "bills",
}


def category_names() -> dict[str, str]:
    """Lower-cased names and ids to ids."""
    return CATEGORY_NAMES | {i: i for i in CATEGORY_NAMES.values()}


def category_id(name: Column) -> Column:
    """The id of a category name, in any case; an unknown name stays as it is."""
    names = F.create_map(*[F.lit(x) for kv in category_names().items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(name)), name)


def closest_category(text: Column, ids: list[str], default: str = "other") -> Column:
    """The first id that contains the text or is contained in it."""
    low = F.lower(text)
    return reduce(lambda acc, i: F.when(low.contains(i) | F.lit(i).contains(low), i).otherwise(acc), reversed(ids), F.lit(default))
