"""Raw input, JSON or text, to a concise description and six fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermint.functions.text import bound, collapse, number

# Field names in order of preference; case, _ and - do not count.
MERCHANT_FIELDS = ["merchantname", "merchant", "name", "storename", "store", "businessname", "seller", "vendor", "payeename", "payee", "recipient", "displayname"]
AMOUNT_FIELDS = ["amount", "value", "total", "totalamount", "transactionamount", "totaldebited", "debitedamount", "paymentamount", "grandtotal"]
TYPE_FIELDS = ["transactiontype", "type", "description", "transactiondescription", "purpose", "category", "memo", "narration", "remarks", "note", "referencetext"]
CURRENCY_FIELDS = ["currency", "currencycode"]
DATE_FIELDS = ["date", "transactiondate", "timestamp", "datetime", "createdat", "valuedate", "postingdate"]
MCC_FIELDS = ["mcc", "mcccode", "merchantcategorycode", "categorycode"]
STATUS_WORDS = ("SUCCESS", "COMPLETED", "APPROVED")
DEPTH, MOST_CHARS, MOST_COMPACT = 3, 500, 200

_MAP = "map<string,string>"


def json_fields(text: Column) -> Column:
    """The entries of a JSON object in document order as map<string, string>; null for anything else."""
    return F.when(F.trim(text).startswith("{"), F.from_json(text, _MAP))


def json_objects(fields: Column, depth: int = DEPTH) -> Column:
    """The objects of a document, itself first and then depth first, to `depth`; each as its entries (key, value, inside).

    Every object is parsed once. `value` is a scalar, or the `value` of a nested object; `inside` holds the entries
    of a nested object. Lists have no value and are not entered.
    """
    entry = "struct<key:string,value:string,inside:array<struct<key:string,value:string>>>"

    def entries(pairs: Column) -> Column:
        nested = lambda e: bound(F.from_json(e["value"], _MAP), lambda m: F.struct(e["key"].alias("key"), m["value"].alias("value"), F.map_entries(m).alias("inside")).cast(entry))
        plain = lambda e: F.struct(e["key"].alias("key"), F.when(~e["value"].startswith("["), e["value"]).alias("value"), F.lit(None).alias("inside")).cast(entry)
        return F.transform(pairs, lambda e: F.when(e["value"].startswith("{"), nested(e)).otherwise(plain(e)))

    def below(own: Column, left: int) -> Column:
        if left <= 1:
            return F.array(own)
        objects = F.filter(own, lambda e: e["inside"].isNotNull())
        return F.concat(F.array(own), F.flatten(F.transform(objects, lambda e: bound(entries(e["inside"]), lambda inner: below(inner, left - 1)))))

    return bound(entries(F.map_entries(fields)), lambda own: below(own, depth))


def find_field(objects: Column, names: list[str], longest: bool = True) -> Column:
    """The value whose key equals or contains a name, in the first of `objects` that has one; of several the longest, or the first in document order. Null without one."""
    plain = lambda k: F.regexp_replace(F.lower(k), "[_-]", "")
    named = lambda e: reduce(lambda a, b: a | b, [plain(e["key"]).contains(n) for n in names]) & e["value"].isNotNull()
    values = lambda o: F.transform(F.filter(o, named), lambda e: e["value"])
    first = lambda v: F.get(v, F.lit(0))
    long = lambda v: F.array_max(F.transform(v, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("order"), x.alias("v"))))["v"]
    picked = F.transform(objects, lambda o: (long if longest else first)(values(o)))
    return first(F.filter(picked, lambda v: v.isNotNull() & (v != "")))


def compact_text(entries: Column, most: int = 3) -> Column:
    """The first entries of an object as `key: value`; of a nested object its first scalar entry, lists are passed over."""
    scalar = lambda e: e["value"].isNotNull() & ~e["value"].startswith("{") & ~e["value"].startswith("[")
    shown = lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    of = lambda e: F.when(e["inside"].isNotNull(), bound(F.get(F.filter(e["inside"], scalar), F.lit(0)), shown)).when(scalar(e), shown(e))
    return F.array_join(F.slice(F.filter(F.transform(entries, of), lambda t: t.isNotNull()), 1, most), ", ")


def _capped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def json_date(value: Column) -> Column:
    """An ISO date from the first 19 characters, in five forms."""
    forms = ["yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy", "yyyy-MM-dd'T'HH:mm:ss"]
    return F.date_format(F.coalesce(*[F.try_to_timestamp(F.substring(value, 1, 19), F.lit(f)) for f in forms]), "yyyy-MM-dd")


def preprocess(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with `prepared`: struct<text, amount, date, currency, merchant, mcc> from a JSON object or plain text."""
    m = json_fields(F.col(text))
    work = df.withColumn("_m", m).withColumn("_o", json_objects(F.col("_m")))
    m, o = F.col("_m"), F.col("_o")
    merchant, kind = find_field(o, MERCHANT_FIELDS), find_field(o, TYPE_FIELDS, longest=False)
    currency, amount = find_field(o, CURRENCY_FIELDS, longest=False), number(find_field(o, AMOUNT_FIELDS, longest=False))
    in_merchant = F.when(m["merchant"].startswith("{"), json_objects(F.from_json(m["merchant"], _MAP)))
    work = work.withColumn("_f", F.struct(merchant.alias("merchant"), kind.alias("kind"), currency.alias("currency"), amount.alias("amount"), json_date(find_field(o, DATE_FIELDS, longest=False)).alias("date"), F.coalesce(find_field(o, MCC_FIELDS, longest=False), find_field(in_merchant, MCC_FIELDS, longest=False)).alias("mcc")))
    f = F.col("_f")
    said = F.upper(f["kind"])
    shown_kind = F.when(~said.isin(*STATUS_WORDS) & ~F.coalesce(F.upper(f["merchant"]).contains(said), F.lit(False)), f["kind"])
    shown_amount = F.when(f["amount"].isNotNull(), F.concat(F.coalesce(f["currency"], F.lit("Rs")), F.lit(" "), F.format_number(f["amount"], 2)))
    shown = F.concat_ws(" ", f["merchant"], shown_kind, shown_amount)
    compact = _capped(compact_text(F.get(o, F.lit(0))), MOST_COMPACT)
    from_json = F.when(shown != "", _capped(shown, MOST_CHARS)).otherwise(compact)
    description = F.when(m.isNotNull(), from_json).otherwise(_capped(collapse(F.col(text)), MOST_CHARS))
    prepared = F.struct(description.alias("text"), f["amount"].alias("amount"), f["date"].alias("date"), F.coalesce(f["currency"], F.lit("INR")).alias("currency"), f["merchant"].alias("merchant"), f["mcc"].alias("mcc"))
    return work.withColumn("prepared", prepared).drop("_m", "_o", "_f")


def with_request_fields(df: DataFrame) -> DataFrame:
    """Fields of the request before those found in the text; a currency other than INR, a found merchant or code win."""
    p = F.col("prepared")
    return df.select("*", F.coalesce("amount", p["amount"]).alias("final_amount"), F.coalesce("date", p["date"]).alias("final_date"), F.when(F.col("currency") != "INR", F.col("currency")).otherwise(p["currency"]).alias("final_currency"), F.coalesce(p["merchant"], "merchant").alias("final_merchant"), F.coalesce(p["mcc"], "mcc").alias("final_mcc"))
