"""Invoices derived from orders and line items: known fields, planted faults, rendered text.

One invoice per order that has line items. All amounts are whole cents. Faults are
planted on order keys divisible by a prime, so that every validation rule fires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions.text import cents_text
from ledgerloom.session import inline_table
from ledgerloom.sources.tables import table

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def _cents(amount: Column) -> Column:
    return F.floor(amount * 100 + 0.5)


def line_cents(spark: SparkSession, folder: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, folder, "lineitem").select(
        *[F.col(c) for c in ["l_orderkey", *LINE_ORDER]],
        _cents(net).alias("amount_c"),
        _cents(net * F.col("l_tax")).alias("tax_c"),
        _cents(F.col("l_extendedprice") * F.col("l_discount")).alias("discount_c"),
        _cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_c"),
    )


def order_sums(lines: DataFrame) -> DataFrame:
    """Per order: sums and the lowest supplier key; partial sums before the shuffle."""
    return lines.groupBy("l_orderkey").agg(
        F.sum("amount_c").alias("subtotal_c"),
        F.sum("tax_c").alias("raw_tax_c"),
        F.sum("discount_c").alias("raw_discount_c"),
        F.min("l_suppkey").alias("first_supp"),
    )


def item_lines(lines: DataFrame, symbols: Column) -> DataFrame:
    """Text of all lines of every order: one value per order, so its lines meet in one row."""
    line = F.concat(
        F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" "),
        F.col("l_quantity").cast("bigint").cast("string"), F.lit(" "),
        cents_text(F.col("unit_c"), symbols), F.lit(" "), cents_text(F.col("amount_c"), symbols),
    )
    in_order = F.sort_array(F.collect_list(F.struct(*LINE_ORDER, line.alias("line"))))
    return lines.groupBy("l_orderkey").agg(
        F.array_join(F.transform(in_order, lambda x: x["line"]), "\n").alias("items")
    )


def _every(prime: int) -> Column:
    return F.col("key") % prime == 0


def invoice_number(key: Column) -> Column:
    width = F.greatest(F.lit(6), F.length(key.cast("string")))
    return F.concat(F.lit("INV-"), F.lpad(key.cast("string"), width, F.lit("0")))


def invoice_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Known fields of every invoice, one row per order with line items."""
    templates = inline_table(spark, fixed.TEMPLATE_SCHEMA, fixed.TEMPLATES)
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"), "o_custkey", F.to_date("o_orderdate").alias("order_day")
    )
    sums = order_sums(line_cents(spark, folder))
    base = (
        orders.join(sums, orders["key"] == sums["l_orderkey"])
        .join(F.broadcast(templates), F.pmod("key", F.lit(7)) == F.col("k"))
    )
    day = (
        F.when(_every(41), F.lit("2099-12-31").cast("date"))
        .when(_every(43), F.col("order_day"))
        .otherwise(F.add_months("order_day", 12 * fixed.DATE_SHIFT_YEARS))
    )
    full = F.col("subtotal_c") + F.col("raw_tax_c")
    total = F.when(_every(53), F.lit(None).cast("bigint")).when(_every(23), full + F.floor(full / 5)).otherwise(full)
    base = base.select(
        "key", "lang", "sym", "subtotal_c", "subtotal_label", "tax_label", "tax_rate", "total_label", "note",
        invoice_number(F.when(_every(31) & (F.col("key") > 0), F.col("key") - 1).otherwise(F.col("key"))).alias("invoice_number"),
        day.alias("invoice_day"),
        F.when(_every(29), "").otherwise(F.concat_ws(" ", "vendor", "first_supp")).alias("vendor_name"),
        F.concat_ws(" ", "buyer", "o_custkey").alias("buyer_name"),
        F.when(_every(59), -F.col("raw_tax_c")).otherwise(F.col("raw_tax_c")).alias("tax_c"),
        total.alias("total_c"),
        F.when(_every(5), F.col("raw_discount_c")).alias("discount_c"),
        F.when(_every(47), "us dollars").otherwise(F.col("currency")).alias("currency"),
        F.when(F.col("currency") == "INR", fixed.GSTIN_LINE)
        .when(F.col("currency").isin("EUR", "GBP"), F.concat(F.lit("VAT No: "), F.upper("lang"), F.lit(fixed.VAT_DIGITS)))
        .otherwise("").alias("tax_id_line"),
        F.when(_every(3), F.concat(F.lit("PO-"), F.lpad(F.col("o_custkey").cast("string"),
               F.greatest(F.lit(6), F.length(F.col("o_custkey").cast("string"))), F.lit("0")))).otherwise("").alias("po_number"),
    )
    due = F.when(_every(37), F.date_sub("invoice_day", 10)).otherwise(F.date_add("invoice_day", 30))
    ext = F.element_at(F.array(*[F.lit(e) for e in fixed.FILE_EXTENSIONS]), (F.pmod("key", F.lit(9)) + 1).cast("int"))
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod("key", F.lit(86400)))
    return base.select(
        "*",
        due.alias("due_day"),
        F.concat(F.lit("invoice_"), F.col("key").cast("string"), ext).alias("filename"),
        (F.col("invoice_day").cast("timestamp_ntz") + seconds).alias("received_at"),
    )


def shown_date(day: Column, key: Column) -> Column:
    """The date in the shape of the invoice's template."""
    shapes = ["MMMM d, yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "d MMMM yyyy", "yyyy/MM/dd", "yyyy-MM-dd"]
    text = F.date_format(day, shapes[0])
    for k, shape in enumerate(shapes[1:], start=1):
        text = F.when(F.pmod(key, F.lit(7)) == k, F.date_format(day, shape)).otherwise(text)
    return text


def invoice_text(spark: SparkSession, folder: str) -> DataFrame:
    """Rendered text of every invoice: doc_id, filename, file_hash, text, received_at."""
    sym = F.element_at(F.array(*[F.lit(t[3]) for t in fixed.TEMPLATES]), (F.pmod("l_orderkey", F.lit(7)) + 1).cast("int"))
    items = item_lines(line_cents(spark, folder), sym)
    facts = invoice_facts(spark, folder)
    joined = facts.join(items, facts["key"] == items["l_orderkey"])
    money = lambda c: cents_text(F.col(c), F.col("sym"))
    optional = lambda label, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(label), value))
    tax = F.concat(F.col("tax_label"), F.lit(" ("), F.col("tax_rate"), F.lit("): "), money("tax_c"))
    lines = [
        F.lit("INVOICE"),
        F.concat(F.lit("Invoice No: "), F.col("invoice_number")),
        F.concat(F.lit("Invoice Date: "), shown_date(F.col("invoice_day"), F.col("key"))),
        F.concat(F.lit("Due Date: "), F.date_format("due_day", "dd/MM/yyyy")),
        F.concat(F.lit("Currency: "), F.col("currency")),
        optional("PO No: ", F.col("po_number")),
        F.lit(""),
        optional("From: ", F.col("vendor_name")),
        F.lit(fixed.SELLER_STREET),
        F.concat(F.lit("Bill To: "), F.col("buyer_name")),
        F.lit(fixed.BUYER_STREET),
        F.lit(""),
        optional("", F.col("tax_id_line")),
        F.lit(fixed.ITEM_HEADER),
        F.col("items"),
        F.lit(""),
        optional("Discount: ", money("discount_c")),
        F.concat(F.col("subtotal_label"), F.lit(": "), money("subtotal_c")),
        tax,
        optional("", F.concat(F.col("total_label"), F.lit(": "), money("total_c"))),
        F.lit(""),
        F.lit(fixed.TERMS_LINE),
        F.lit(fixed.BANK_LINE),
        F.col("note"),
    ]
    text = joined.select(
        (F.col("key") + 1).alias("doc_id"), "key", "filename", "received_at", F.concat_ws("\n", *lines).alias("text")
    )
    return text.select("doc_id", "key", "filename", F.sha2("text", 256).alias("file_hash"), "text", "received_at")
