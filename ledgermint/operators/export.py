"""Exports: accounting tables and lines, nested JSON, batch results, partitioned appends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgermint.functions.text import cache_key

from .merchant_codes import category_id, category_names

# Accounts and codes by category name; the default for the rest; the header and columns of the files.
LEDGER_ACCOUNTS = {
    "Food & Dining": "Meals & Entertainment",
    "Groceries": "Groceries",
    "Transport": "Auto & Travel",
    "Fuel": "Auto & Travel",
    "Shopping": "Merchandise",
    "Bills": "Utilities",
    "Utilities": "Utilities",
    "Rent": "Rent",
    "Health": "Medical",
    "Education": "Education",
    "Entertainment": "Meals & Entertainment",
    "Travel": "Auto & Travel",
    "Fees & Charges": "Bank Charges",
    "Other": "Other Expenses",
}
CODED_ACCOUNTS = {
    "Food & Dining": "200",
    "Groceries": "201",
    "Transport": "202",
    "Fuel": "202",
    "Shopping": "203",
    "Bills": "204",
    "Utilities": "204",
    "Rent": "205",
    "Health": "206",
    "Education": "207",
    "Entertainment": "208",
    "Travel": "202",
    "Fees & Charges": "209",
    "Other": "299",
}
OTHER_LEDGER, OTHER_CODE, TAX_RATE, TAX_TYPE, BANK = "Other Expenses", "299", 0.18, "GST", "Bank Account"
INTERCHANGE_HEADER = ["!TRNS\tDATE\tACCNT\tAMOUNT\tMEMO", "!SPL\tDATE\tACCNT\tAMOUNT\tMEMO", "!ENDTRNS"]
CODED_COLUMNS = ["*ContactName", "*InvoiceNumber", "*InvoiceDate", "*DueDate", "InventoryItemCode", "Description", "Quantity", "UnitAmount", "AccountCode", "*TaxType", "TaxAmount", "LineAmount"]


def account(category: Column, accounts: dict[str, str] = LEDGER_ACCOUNTS, other: str = OTHER_LEDGER) -> Column:
    """The account of a category, by id or name."""
    ids = category_names()
    by_id = {ids[name.lower()]: value for name, value in accounts.items()}
    table = F.create_map(*[F.lit(x) for kv in by_id.items() for x in kv])
    return F.coalesce(F.try_element_at(table, category_id(category)), F.lit(other))


def _money(amount: Column) -> Column:
    return F.format_string("%.2f", F.abs(F.coalesce(amount.cast("double"), F.lit(0.0))))


def _merchant(df: DataFrame) -> Column:
    return F.coalesce(F.col("merchant_resolved") if "merchant_resolved" in df.columns else F.col("merchant") if "merchant" in df.columns else F.lit(None), F.lit(""))


def ledger_csv(df: DataFrame, explanations: bool = False) -> DataFrame:
    """The ten columns of an accounting CSV, and two more with `explanations` (an array of texts, and the votes of rule and model)."""
    cols = ["date", "amount", F.coalesce("currency", F.lit("INR")).alias("currency"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("subcategory", F.lit("")).alias("subcategory"), _merchant(df).alias("merchant"), F.col("text").alias("description"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("method", F.lit("")).alias("method"), F.coalesce("requires_review", F.lit(False)).alias("requires_review")]
    said = lambda m: F.coalesce(F.col(f"{m}_category"), F.lit("N/A")) if f"{m}_category" in df.columns else F.lit("N/A")
    more = [F.array_join("explanations", "; ").alias("explanations"), F.concat(F.lit("Rule: "), said("rule"), F.lit(", ML: "), said("ml")).alias("ensemble_votes")] if explanations else []
    return df.select(*cols, *more)


def interchange_lines(df: DataFrame) -> DataFrame:
    """(txn_key, nth, line): a TRNS, SPL and ENDTRNS line per transaction; headers are `INTERCHANGE_HEADER`."""
    amount, memo = _money(F.col("amount")), F.coalesce("text", F.lit(""))
    line = lambda kind, to, money: F.concat_ws("\t", F.lit(kind), F.coalesce("date", F.lit("")), to, money, memo)
    lines = F.array(line("TRNS", account(F.col("category")), F.concat(F.lit("-"), amount)), line("SPL", F.lit(BANK), amount), F.lit("ENDTRNS"))
    return df.select("txn_key", F.posexplode(lines).alias("nth", "line"))


def coded_csv(df: DataFrame, tax: float = TAX_RATE) -> DataFrame:
    """The twelve columns of an invoice CSV with account codes and tax."""
    amount = F.abs(F.coalesce(F.col("amount").cast("double"), F.lit(0.0)))
    values = [
        _merchant(df), F.format_string("TXN-%s", F.col("txn_key").cast("string")), F.col("date"), F.col("date"), F.lit(""), F.col("text"), F.lit("1"), _money(F.col("amount")),
        account(F.col("category"), CODED_ACCOUNTS, OTHER_CODE), F.lit(TAX_TYPE), F.format_string("%.2f", amount * tax), _money(F.col("amount")),
    ]
    return df.select(*[v.alias(c) for v, c in zip(values, CODED_COLUMNS, strict=True)])


def json_column(df: DataFrame, form: str = "standard") -> Column:
    """The document of a transaction in one of three forms; fields without value stay."""
    amount = F.abs(F.coalesce(F.col("amount").cast("double"), F.lit(0.0)))
    named = F.struct(F.coalesce("category", F.lit("Other")).alias("name"))
    forms = {
        "standard": F.struct(*df.columns),
        "ledger": F.struct(F.col("date").alias("TxnDate"), amount.alias("Amount"), named.alias("AccountRef"), F.array(F.struct(amount.alias("Amount"), F.lit("AccountBasedExpenseLineDetail").alias("DetailType"), F.struct(named.alias("AccountRef")).alias("AccountBasedExpenseLineDetail"))).alias("Line")),
        "coded": F.struct(F.lit("ACCREC").alias("Type"), F.struct(_merchant(df).alias("Name")).alias("Contact"), F.col("date").alias("Date"), F.array(F.struct(F.col("text").alias("Description"), F.lit(1).alias("Quantity"), amount.alias("UnitAmount"), F.lit("200").alias("AccountCode"))).alias("LineItems")),
    }
    return F.to_json(forms[form], {"ignoreNullFields": "false"})


def nested_json(df: DataFrame, form: str = "standard") -> DataFrame:
    """(txn_key, json): one document per transaction in one of three forms (`json_column`)."""
    return df.select("txn_key", json_column(df, form).alias("json"))


def batch_result(df: DataFrame) -> DataFrame:
    """The seven columns of a batch download."""
    return df.select("text", "category", F.coalesce("subcategory", F.lit("")).alias("subcategory"), F.format_string("%.1f%%", F.round(F.col("confidence") * 100, 1)).alias("confidence"), "method", F.when(F.col("requires_review"), "Yes").otherwise("No").alias("review"), F.coalesce("merchant_resolved", F.lit("")).alias("merchant"))


def cache_rows(df: DataFrame, now: Column, seconds: int = 600) -> DataFrame:
    """(cache_key, answer, expires_at): what a result cache keeps of routed rows: those that need no review."""
    key = cache_key(*[F.col(c) for c in ("text", "amount", "date", "currency")])
    answer = F.to_json(F.struct("text", "category", "subcategory", "confidence", "method"))
    return df.where(~F.col("requires_review")).select(key.alias("cache_key"), answer.alias("answer"), (now + F.make_dt_interval(secs=F.lit(seconds))).alias("expires_at"))


def confirmed_cache_rows(feedback: DataFrame, now: Column, seconds: int = 600) -> DataFrame:
    """What the cache keeps of feedback (text, amount, date, correct_category, correct_subcategory): sure, as `user_feedback_cached`."""
    rows = feedback.select("text", "amount", "date", F.lit("INR").alias("currency"), F.col("correct_category").alias("category"), F.col("correct_subcategory").alias("subcategory"), F.lit(1.0).alias("confidence"), F.lit("user_feedback_cached").alias("method"), F.lit(False).alias("requires_review"))
    return cache_rows(rows, now, seconds)


def accepted(df: DataFrame) -> DataFrame:
    """The rows of a routed batch that are stored: no review, money and confidence as decimals, a bad date as null, and the month to partition by."""
    day = F.col("date").try_cast("date")
    return df.where(~F.col("requires_review")).select("txn_key", "text", F.col("amount").cast("decimal(15,2)").alias("amount"), day.alias("date"), "category", "subcategory", F.col("confidence").cast("decimal(5,4)").alias("confidence"), "method", F.date_format(day, "yyyy-MM").alias("month"))


def append_accepted(df: DataFrame, path: str) -> None:
    accepted(df).write.mode("append").partitionBy("month").parquet(path)


def append_feedback(df: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Feedback by day."""
    df.withColumn("day", F.date_format(ts, "yyyyMMdd")).write.mode("append").partitionBy("day").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_gazetteer(df: DataFrame, path: str) -> None:
    df.select("merchant_id", "canonical_name", "aliases", "category", "subcategory").write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_interchange(df: DataFrame, path: str) -> None:
    """Header and lines as text, in order: the range partitions of the sort are the files."""
    header = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(h) for h in INTERCHANGE_HEADER])).alias("nth", "line")).select(F.lit(None).cast("bigint").alias("txn_key"), "nth", "line")
    header.unionByName(interchange_lines(df)).orderBy(F.asc_nulls_first("txn_key"), "nth").select("line").write.mode("overwrite").text(path)


def write_metrics(summary: DataFrame, path: str) -> None:
    """A summary of a few rows as JSON."""
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def fairness_report(by_amount: DataFrame, by_class: DataFrame, overall: DataFrame) -> DataFrame:
    """(pos, line): a Markdown report from accuracy by amount (range, n, accuracy), by class (class, n, accuracy), and overall (accuracy): small tables all."""
    share = lambda c: F.when(F.col(c).isNull(), "nan%").otherwise(F.format_string("%.2f%%", F.round(F.col(c) * 100, 2)))
    head = lambda at, *lines: overall.select(F.inline(F.array(*[F.struct(F.lit(at).alias("part"), F.lit(float(i)).alias("at"), F.lit("").alias("tie"), F.lit(x).alias("line")) for i, x in enumerate(lines)])))
    row = lambda df, at, name, order: df.select(F.lit(at).alias("part"), order.cast("double").alias("at"), F.col(name).alias("tie"), F.concat(F.lit("| "), F.col(name), F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), share("accuracy"), F.lit(" |")).alias("line"))
    place = F.when(F.col("range") == "small", 0).when(F.col("range") == "medium", 1).otherwise(2)
    gap = by_amount.agg((F.max("accuracy") - F.min("accuracy")).alias("gap"))
    parts = [
        head(0, "# Fairness report"), overall.select(F.lit(1).alias("part"), F.lit(0.0).alias("at"), F.lit("").alias("tie"), F.concat(F.lit("**Overall accuracy**: "), share("accuracy")).alias("line")),
        head(2, "## By amount", "| Range | Count | Accuracy |", "|---|---|---|"), row(by_amount, 3, "range", place),
        gap.select(F.lit(4).alias("part"), F.lit(0.0).alias("at"), F.lit("").alias("tie"), F.concat(F.lit("**Max disparity**: "), share("gap"), F.when(F.col("gap") > 0.1, " (warning)").otherwise(" (pass)")).alias("line")),
        head(5, "## By class", "| Class | Count | Accuracy |", "|---|---|---|"), row(by_class, 6, "class", F.col("n")),
    ]
    lines = reduce(lambda a, b: a.unionByName(b), parts)
    return lines.select(F.row_number().over(Window.orderBy("part", "at", "tie")).alias("pos"), "line")  # some dozens of lines


def write_report(report: DataFrame, path: str) -> None:
    """The lines of a report as one text file."""
    report.orderBy("pos").select("line").coalesce(1).write.mode("overwrite").text(path)
