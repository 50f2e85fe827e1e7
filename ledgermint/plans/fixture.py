"""Transactions derived from the benchmark tables, by SQL that both engines read, and small dimensions.

One text template per line number and one brand per part exercise channels, merchants, codes and rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgermint.functions.lineage import spread
from ledgermint.operators.rules import Category

#: (brand, category, subcategory, aliases), by part key.
BRANDS = [
    ("ZOMATO", "food_dining", "Food Delivery", "zomato,zmt,zomato pay,zomato*"), ("SWIGGY", "food_dining", "Food Delivery", "swiggy,swgy,swiggy*"), ("BIGBASKET", "groceries", "Online Grocery", "bigbasket,big basket,bbasket"), ("DMART", "groceries", "Supermarkets", "dmart,d mart,avenue supermarts"),
    ("UBER", "transport", "Cabs", "uber,uber trip,uber india"), ("RAPIDO", "transport", "Bike Taxi", "rapido,rapido bike"), ("MAKEMYTRIP", "travel", "Travel Booking", "makemytrip,make my trip,mmt"), ("HPCL", "fuel", "Petrol/Diesel", "hpcl,hp petrol,hindustan petroleum"),
    ("AMAZON", "shopping", "Online Shopping", "amazon,amzn,amazon pay,amazon india"), ("FLIPKART", "shopping", "Online Shopping", "flipkart,fkrt,flip kart"), ("BOOKMYSHOW", "entertainment", "Movies", "bookmyshow,book my show,bms"), ("NETFLIX", "subscriptions_memberships", "Streaming", "netflix,netflix.com"),
    ("APOLLO", "health", "Pharmacy", "apollo,apollo pharmacy"), ("AIRTEL", "bills", "Phone/Internet", "airtel,bharti airtel"), ("ZERODHA", "investments", "Stocks", "zerodha,zerodha broking"), ("PVR", "entertainment", "Movies", "pvr,pvr cinemas"),
]
CODES_OF_PARTS = ["5812", "5411", "4121", "5541", "5311", "7832", "8011", "9999"]

TAXONOMY = [
    Category("food_dining", "Food & Dining", ("zomato", "swiggy", "restaurant", "cafe", "pizza", "bistro"), (".*food.*delivery.*", ".*restaurant.*"), ("Food Delivery", "Restaurants", "Fast Food")),
    Category("groceries", "Groceries", ("bigbasket", "dmart", "grocery", "supermarket", "milk"), (".*grocer.*",), ("Online Grocery", "Supermarkets")),
    Category("transport", "Transport", ("uber", "rapido", "taxi", "metro", "cab"), (".*(uber|rapido).*",), ("Cabs", "Bike Taxi")),
    Category("travel", "Travel", ("makemytrip", "hotel", "flight", "airline"), (".*(hotel|flight).*",), ("Travel Booking", "Hotels")),
    Category("fuel", "Fuel", ("hpcl", "petrol", "diesel", "fuel"), (".*(petrol|diesel).*",), ("Petrol/Diesel",)),
    Category("shopping", "Shopping", ("amazon", "flipkart", "widget", "gadget", "ring"), (".*(amazon|flipkart).*", ".*order.*"), ("Online Shopping", "Retail")),
    Category("entertainment", "Entertainment", ("bookmyshow", "pvr", "cinema", "movie"), (".*(movie|cinema).*",), ("Movies", "Events")),
    Category("health", "Health", ("apollo", "pharmacy", "clinic"), (".*pharma.*",), ("Pharmacy", "Doctor/Hospital")),
    Category("bills", "Bills", ("airtel", "recharge", "bill"), (".*bill.*",), ("Phone/Internet", "Utilities")),
    Category("investments", "Investments", ("zerodha", "mutual fund", "sip"), (".*(zerodha|groww).*",), ("Stocks", "Mutual Funds")),
    Category("transfers_upi", "Transfers/UPI", ("transfer", "imps", "neft"), (".*(imps|neft|rtgs).*",), ("Peer to Peer", "Bank Transfer")),
    Category("atm_cash", "ATM/Cash", ("atm", "cash withdrawal"), (".*atm.*",), ("Cash Withdrawal",)),
    Category("rent", "Rent", ("rent", "landlord", "lease"), (".*rent.*",), ("rent",)),
    Category("subscriptions_memberships", "Subscriptions & Memberships", ("netflix", "spotify", "subscription"), (".*subscription.*",), ("Streaming",)),
    Category("other", "Other", ("other", "misc"), (".*",), ("Miscellaneous", "Uncategorized")),
]


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def txn_sql(source=lambda t: t) -> str:
    """The transactions as a query over `source`(table)."""
    brand, label, code = _case("(l_partkey % 16)", [b[0] for b in BRANDS]), _case("(l_partkey % 16)", [b[1] for b in BRANDS]), _case("(l_partkey % 8)", CODES_OF_PARTS)
    key = "cast(l_orderkey as string)"
    return f"""SELECT l_orderkey * 8 + l_linenumber AS txn_key, l_linenumber AS template,
CASE l_linenumber WHEN 1 THEN 'UPI-' || {key} || '-' || {brand} || ' PAY' WHEN 2 THEN 'POS ' || cast(l_suppkey as string) || ' ' || {brand} || ' ' || p_name
WHEN 3 THEN 'ATM WDL ' || {key} || ' MUMBAI' WHEN 4 THEN 'NEFT TO LANDLORD RENT ' || cast(month(l_shipdate) as string) WHEN 5 THEN 'IMPS-' || {key} || '-TO-VIKAS'
WHEN 6 THEN 'POS PUR / ' || {code} || ' / ' || p_name ELSE 'REFUND ' || {brand} || ' ORDER ' || {key} END AS text,
cast(floor(l_extendedprice) as double) / 100 AS amount, cast(cast(l_shipdate as date) as string) AS date, 'INR' AS currency,
CASE WHEN l_linenumber = 2 AND l_suppkey % 3 = 0 THEN {code} END AS mcc, o_custkey AS account, l_returnflag AS flag,
CASE l_linenumber WHEN 3 THEN 'atm_cash' WHEN 4 THEN 'rent' WHEN 5 THEN 'transfers_upi' WHEN 7 THEN 'income_salary' ELSE {label} END AS label
FROM {source('lineitem')} JOIN {source('part')} ON l_partkey = p_partkey JOIN {source('orders')} ON l_orderkey = o_orderkey"""


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part", "orders")}
    return spark.sql(txn_sql(lambda t: "{" + t + "}"), **tables | {"lineitem": spread(tables["lineitem"])})


def gazetteer(spark: SparkSession) -> DataFrame:
    """(row_pos, merchant_id, canonical_name, aliases, category, subcategory)."""
    return spark.createDataFrame([(i, i + 1, b, a, c, s) for i, (b, c, s, a) in enumerate(BRANDS)], "row_pos int, merchant_id int, canonical_name string, aliases string, category string, subcategory string")


def with_txn(query: str, *ctes: str) -> str:
    """A query over `txn` and further common table expressions for the other engine."""
    more = query if query.lstrip().startswith(",") else f" {query}"  # a query may begin with further expressions
    return "WITH RECURSIVE " + ", ".join([f"txn AS ({txn_sql()})", *ctes]) + more
