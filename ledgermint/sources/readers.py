"""Sources: JSON lines, gazetteers, taxonomies, bank and card exports, uploads, statement lines and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermint.functions.text import bound, collapse, contains_any, number, parsed_date
from ledgermint.operators.learn import numbered
from ledgermint.operators.preprocess import json_fields
from ledgermint.operators.rules import Category

# Column names of bank exports, in order of preference.
DESCRIPTION_COLUMNS = ["TRANSACTION DETAILS", "description", "Description", "transaction", "Transaction", "narration", "Narration", "text", "Text"]
AMOUNT_COLUMNS = ["WITHDRAWAL AMT", "DEPOSIT AMT", "amount", "Amount", "debit", "Debit", "credit", "Credit"]
HEADER_WORDS = ("date", "transaction", "description", "merchant", "amount")
#: Words of the header and footer lines of statements.
STATEMENT_NOISE = (
    "page", "statement", "account", "branch", "ifsc", "customer",
    "opening balance", "closing balance", "total", "subtotal",
    "continued", "date", "particulars", "debit", "credit", "balance",
    "generated on", "printed on", "bank", "address", "phone",
)
JSON_TEXT_FIELDS = ("text", "transaction", "description", "name")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; blank lines go, broken ones are nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(row_pos, merchant_id, canonical_name, aliases, category, subcategory) of a CSV with quoted alias lists; row_pos follows its order."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path).withColumn("_at", F.monotonically_increasing_id())
    return numbered(raw, "_at", 0).select(F.col("number").cast("int").alias("row_pos"), F.col("merchant_id").cast("int").alias("merchant_id"), "canonical_name", "aliases", "category", "subcategory")


def load_taxonomy(path: str) -> list[Category]:
    """Categories of a YAML taxonomy, a configuration file; regular expressions that do not compile go."""
    import re

    import yaml

    def fine(p: str) -> bool:
        try:
            re.compile(p)
        except re.error:
            return False
        return True

    with open(path, encoding="utf-8") as f:
        listed = yaml.safe_load(f)["categories"]
    names = lambda c, k: tuple(str(x) for x in c.get(k) or ())
    return [Category(c["id"], c["name"], tuple(k.lower() for k in names(c, "keywords")), tuple(p.replace("(?i)", "") for p in names(c, "patterns") if fine(p)), names(c, "subcategories"), names(c, "mcc_codes")) for c in listed]


def taxonomy_tables(spark: SparkSession, taxonomy: list[Category]) -> dict[str, DataFrame]:
    """The taxonomy as small tables with positions."""
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "category": make([(i, c.id, c.name) for i, c in enumerate(taxonomy)], "pos int, id string, name string"),
        "keyword": make([(i, j, c.id, k) for i, c in enumerate(taxonomy) for j, k in enumerate(c.keywords)], "cat_pos int, pos int, category string, keyword string"),
        "pattern": make([(i, j, c.id, p) for i, c in enumerate(taxonomy) for j, p in enumerate(c.patterns)], "cat_pos int, pos int, category string, pattern string"),
        "subcategory": make([(i, j, c.id, s) for i, c in enumerate(taxonomy) for j, s in enumerate(c.subcategories)], "cat_pos int, pos int, category string, subcategory string"),
        "mcc": make([(c.id, m) for c in taxonomy for m in c.mcc_codes], "category string, mcc string"),
    }


def bank_rows(raw: DataFrame) -> DataFrame:
    """(text, amount) of a bank export: the first known description column, the first amount that is a number."""
    text = next((c for c in DESCRIPTION_COLUMNS if c in raw.columns), None)
    amounts = [number(F.trim(F.col(f"`{c}`").cast("string"))) for c in AMOUNT_COLUMNS if c in raw.columns]
    if text is None:
        return raw.select(F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("amount")).limit(0)
    return raw.select(F.trim(F.col(f"`{text}`")).alias("text"), (F.coalesce(*amounts) if amounts else F.lit(None).cast("double")).alias("amount")).where("text <> ''")


def read_bank_csv(spark: SparkSession, path: str) -> DataFrame:
    return bank_rows(spark.read.option("header", True).csv(path))


def card_rows(raw: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label, amount) of a card export, for the foreign labels that `labels` (foreign, label), a small table, maps."""
    rows = raw.select(F.col("Merchant Name").alias("text"), F.col("Category").alias("foreign"), number(F.col("Transaction Amount")).alias("amount"))
    return rows.join(F.broadcast(labels), "foreign").select("text", "label", "amount")


def read_card_csv(spark: SparkSession, path: str, labels: DataFrame) -> DataFrame:
    return card_rows(spark.read.option("header", True).csv(path), labels)


def sniffed(name: Column, content: Column) -> Column:
    """json, csv or txt, by the file's extension, else by its content."""
    ext, head = F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1)), F.ltrim(content)
    by_content = F.when(head.startswith("[") | head.startswith("{"), "json").when(content.contains(",") & content.contains("\n"), "csv").otherwise("txt")
    return F.when(ext.isin("json", "csv", "txt"), ext).otherwise(by_content)


def upload_rows(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """(name, pos, text) of uploaded files: JSON arrays of texts or objects, CSV lines without header, text lines."""
    work = files.select(F.col(name).alias("name"), F.col(content).alias("content"), sniffed(F.col(name), F.col(content)).alias("kind"))
    wrapped = F.get_json_object("content", "$.transactions")
    listed = F.from_json(F.coalesce(wrapped, F.col("content")), "array<string>")
    as_json = F.when(F.col("kind") == "json", listed)
    fields = lambda e: F.from_json(e, "map<string,string>")
    of_object = lambda e: F.coalesce(*[fields(e)[k] for k in JSON_TEXT_FIELDS])
    texts = F.transform(as_json, lambda e: F.when(e.startswith("{"), of_object(e)).otherwise(e))
    lines = F.split("content", "\n")
    first = F.lower(F.get(lines, F.lit(0)))
    header = (F.col("kind") == "csv") & first.rlike("|".join(HEADER_WORDS))
    plain = F.when(header, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    rows = F.when(texts.isNotNull(), texts).otherwise(plain)
    out = work.select("name", F.posexplode(rows).alias("pos", "text")).withColumn("text", F.trim(F.regexp_replace("text", "\r", "")))
    return out.where("text IS NOT NULL AND text <> ''")


def is_statement_noise(line: Column) -> Column:
    return bound(F.lower(line), lambda low: contains_any(low, STATEMENT_NOISE))


def statement_lines(text: Column) -> Column:
    """The lines of a statement that may be transactions."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 10) & ~is_statement_noise(x))


#: A line with date, text and amount; a date at the start; an amount at the end.
_WHOLE = r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\s+(.+?)\s+([\d,]+\.?\d*)\s*$"
_LEADING_DATE, _LAST_AMOUNT = r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\s+", r"\s+[\d,]+\.?\d*\s*$"


def statement_rows(docs: DataFrame, id_col: str, text_col: str, amounts: bool = True) -> DataFrame:
    """(id, pos, date, text, amount) of statement texts.

    Lines with date, text and amount give all three; others, and all without `amounts`, the text without
    leading date and last amount, if it is longer than five characters.
    """

    def of_line(line: Column, day: Column) -> Column:
        got = lambda g: F.trim(F.regexp_extract(line, _WHOLE, g))
        bare = F.trim(F.regexp_replace(F.regexp_replace(line, _LEADING_DATE, ""), _LAST_AMOUNT, ""))
        whole = F.lit(amounts) & (day != "")
        return F.struct(F.when(whole, parsed_date(day)).alias("date"), F.when(whole, got(2)).otherwise(bare).alias("text"), F.when(whole, number(got(3))).alias("amount"), whole.alias("whole"))

    # read before the lines become rows: a filter on rows would repeat the patterns
    read = F.transform(statement_lines(F.col(text_col)), lambda x: bound(F.regexp_extract(x, _WHOLE, 1), lambda day: of_line(x, day)))
    rows = docs.select(id_col, F.posexplode(read).alias("pos", "_line")).where("_line.whole OR length(_line.text) > 5")
    return rows.select(id_col, "pos", "_line.date", "_line.text", "_line.amount")


#: Header words of the columns of statement tables.
TABLE_COLUMNS = {"text": ("description", "transaction", "particulars", "narration", "details"), "amount": ("amount", "debit", "withdrawal", "paid"), "date": ("date", "transaction date", "value date")}


def statement_table(rows: DataFrame, doc: str = "doc", table: str = "table", pos: str = "row_pos", cells: str = "cells") -> DataFrame:
    """(doc, table, row_pos, date, text, amount) of table rows given as arrays of cells: columns by the words of row 0, else the first long text cell."""
    head = rows.where(F.col(pos) == 0).select(doc, table, *[_first_column(cells, w).alias(f"_{k}") for k, w in TABLE_COLUMNS.items()])
    body = rows.where(F.col(pos) > 0).join(head, [doc, table], "left")
    cell = lambda k: F.try_element_at(F.col(cells), F.col(f"_{k}"))
    long_text = F.get(F.filter(cells, lambda c: F.length(F.trim(c)) > 5), F.lit(0))
    out = body.select(doc, table, pos, parsed_date(cell("date")).alias("date"), F.trim(F.coalesce(F.nullif(F.trim(cell("text")), F.lit("")), long_text)).alias("text"), number(F.regexp_replace(cell("amount"), "[^0-9.-]", "")).alias("amount"))
    return out.where(F.col("text").isNotNull() & (F.length("text") > 0) & ~is_statement_noise(F.col("text")))


def _first_column(cells: str, words: tuple[str, ...]) -> Column:
    """The place, from 1, of the first cell that holds the first word that any cell holds."""
    tries = []
    for word in words:
        tries.append(F.nullif(F.array_position(_holds(cells, word), True), F.lit(0)))
    return F.coalesce(*tries).cast("int")


def _holds(cells: str, word: str) -> Column:
    return F.transform(F.col(cells), lambda c: F.lower(c).contains(word))


def admitted(df: DataFrame, text: str = "text", most: int | None = 1000, order: str | None = None) -> DataFrame:
    """The rows of a batch request: trimmed, not empty, at most `most` (None: all), the first by `order` where that is given."""
    rows = df.withColumn(text, F.trim(text)).where(F.col(text) != "")
    return rows if most is None else (rows.orderBy(order) if order else rows).limit(most)


def from_request_json(df: DataFrame, column: str = "body") -> DataFrame:
    """`df` with the fields of a JSON body as a map."""
    return df.withColumn("fields", json_fields(F.col(column)))


def read_few_shot(spark: SparkSession, path: str, most: int = 20) -> DataFrame:
    """The few-shot examples of a JSON lines file (text, category, amount, currency): the first two of each category, `most` in all."""
    from ledgermint.operators.dataset import few_shot

    rows = read_jsonl(spark, path, "text string, category string, amount double, currency string").withColumn("_at", F.monotonically_increasing_id())
    return few_shot(numbered(rows, "_at").withColumnRenamed("number", "pos"), most=most, label="category").drop("_at")


def read_saved(spark: SparkSession, path: str, months: tuple[str, str] | None = None) -> DataFrame:
    """Stored transactions or feedback; of transactions, the partitions of the months from one to another, both included."""
    rows = spark.read.parquet(path)
    return rows if months is None else rows.where(F.col("month").between(*months))
