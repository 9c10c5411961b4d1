"""Invoices written out as text, so that what reads text has rows whose answers are known: those that were written.

Every row of ``uploads``, ``invoices``, ``vendors`` and ``line_items`` takes part.  Only the writing is simplified: letters of descriptions, whole quantities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.runtime import read_table

MONEY = "decimal(18,2)"


def once(spark: SparkSession, d: str, table: str, key: str, *columns: str) -> DataFrame:
    """``key`` and ``columns`` of a table, one row a key: redelivered rows count once, of copies that disagree the smallest, nulls first."""
    t = read_table(spark, d, table).where(F.col(key).isNotNull())
    if not columns:
        return t.select(key).distinct()
    return t.groupBy(key).agg(F.min(F.struct(*columns)).alias("_x")).select(key, "_x.*")


def once_sql(table: str, key: str, *columns: str) -> str:
    """The same in SQL, as a table in brackets."""
    listed = ", ".join((key, *columns))
    if not columns:
        return f"(select distinct {key} from {table} where {key} is not null)"
    order = ", ".join(f"{c} asc nulls first" for c in columns)
    return f"(select {listed} from (select {listed}, row_number() over (partition by {key} order by {order}) as rn_ from {table} where {key} is not null) where rn_ = 1)"


def _text(c: str) -> Column:
    return F.format_string("%.2f", F.abs(F.col(c)).cast("double"))


#: What is written, by name; each line is left out where its value is null.
LINE_NAMES = ("title", "number", "date", "place", "seller", "seller_gstin", "state", "bill_to", "buyer", "pan", "email", "phone", "reference", "ack", "irn", "discount", "freight", "sub", "cgst", "sgst", "igst", "off", "total", "qty", "words", "computed", "sign")


def rendered_invoices(spark: SparkSession, d: str) -> DataFrame:
    """``upload_id, texts``: the lines of one invoice an upload."""
    i = once(spark, d, "invoices", "upload_id", "invoice_no", "invoice_date_raw", "place_of_supply", "net_total", "tax_total", "gross_total", "cgst", "sgst", "igst", "round_off_delta")
    u = once(spark, d, "uploads", "upload_id", "vendor_id", "page_count")
    i = i.join(u, "upload_id", "left").join(read_table(spark, d, "vendors").select("vendor_id", "vendor_gstin", "legal_name"), "vendor_id", "left")
    id_, c = F.col("upload_id").cast("string"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    gstin = F.col("vendor_gstin")
    values = {
        "title": F.lit("Tax Invoice"), "number": c("Invoice No.: ", F.col("invoice_no")), "date": c("Dated: ", F.col("invoice_date_raw")), "place": c("Place of Supply: ", F.col("place_of_supply")),
        "seller": c("M/s ", F.col("legal_name")), "seller_gstin": c("GSTIN: ", gstin), "state": c("State Name : Neelgarh, Code : ", F.substring(gstin, 1, 2)), "bill_to": F.lit("Bill To"), "buyer": c("Buyer ", id_),
        "pan": c("PAN ", F.substring(gstin, 3, 10)), "email": c("Mail: desk", id_, "@example.in"), "phone": c("Contact No: +91", F.lpad((F.col("upload_id") % 1000000 + 9000000000).cast("string"), 10, "0")),
        "reference": c("Reference No. R/", id_, " of 05/06/2024"), "ack": c("Ack No: 17", id_), "irn": c("IRN: ", F.translate(F.substring(F.sha2(id_, 256), 1, 20), "6789", "abcd")),
        "discount": c("Discount ", _text("round_off_delta")), "freight": F.lit("Freight charges 10.00"), "sub": c("Sub Total ₹ ", _text("net_total")), "cgst": c("CGST@9% ₹ ", _text("cgst")), "sgst": c("SGST@9% ", _text("sgst")),
        "igst": c("IGST: ", _text("igst")), "off": c("Round off ", F.when(F.col("round_off_delta") < 0, "- ").otherwise(""), "₹ ", _text("round_off_delta")),
        "total": c(F.when(F.col("upload_id") % 3 == 0, "Total ₹ ").when(F.col("upload_id") % 3 == 1, "Total ").otherwise("Grand Total: Rs. "), _text("gross_total")), "qty": c("Total ", F.col("page_count").cast("string")),
        "words": F.lit("Invoice Amount In Words\nTen Rupees only"), "computed": F.when(F.col("upload_id") % 2 == 0, F.lit("This is a Computer Generated Invoice")), "sign": c("for ", F.col("legal_name")),
    }
    texts = F.flatten(F.transform(F.filter(F.array(*(values[n] for n in LINE_NAMES)), lambda x: x.isNotNull()), lambda x: F.split(x, "\n")))
    return i.select("upload_id", texts.alias("texts"))


RENDERED_SQL = f"""inv as (select i.*, u.vendor_id, u.page_count, v.vendor_gstin as gstin, v.legal_name from {once_sql("invoices", "upload_id", "invoice_no", "invoice_date_raw", "place_of_supply", "net_total", "tax_total", "gross_total", "cgst", "sgst", "igst", "round_off_delta")} i
 left join {once_sql("uploads", "upload_id", "vendor_id", "page_count")} u using (upload_id) left join vendors v on u.vendor_id = v.vendor_id)"""

WORDS = r"[^A-Za-z]+"


def rendered_lines(spark: SparkSession, d: str) -> DataFrame:
    """``line_id, upload_id, article, code, pieces, price, amount``: lines as they are written, all fields set."""
    li = once(spark, d, "line_items", "line_id", "upload_id", "description", "hsn", "qty_value", "unit_price", "net_amount")
    word = F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), WORDS, " "))
    return li.select(
        "line_id", "upload_id", F.when(word == "", "Goods").otherwise(word).alias("article"), F.coalesce(F.nullif(F.regexp_extract("hsn", r"^([0-9]{4,8})$", 1), F.lit("")), F.lit("9999")).alias("code"),
        F.coalesce(F.nullif(F.regexp_extract("qty_value", r"([0-9]{1,4})", 1), F.lit("")), F.lit("1")).alias("pieces"), F.coalesce(F.abs(F.col("unit_price")).cast(MONEY), F.lit(1).cast(MONEY)).alias("price"), F.coalesce(F.abs(F.col("net_amount")).cast(MONEY), F.lit(1).cast(MONEY)).alias("amount"),
    )


WRITTEN_SQL = rf"""written as (select line_id, upload_id, case when w = '' then 'Goods' else w end as article, coalesce(nullif(regexp_extract(hsn, '^([0-9]{{4,8}})$', 1), ''), '9999') as code, coalesce(nullif(regexp_extract(qty_value, '([0-9]{{1,4}})', 1), ''), '1') as pieces,
 coalesce(cast(abs(unit_price) as decimal(18,2)), 1.00) as price, coalesce(cast(abs(net_amount) as decimal(18,2)), 1.00) as amount
 from (select *, trim(regexp_replace(coalesce(description, ''), '{WORDS}', ' ', 'g')) as w from {once_sql("line_items", "line_id", "upload_id", "description", "hsn", "qty_value", "unit_price", "net_amount")}))"""


def rendered_tables(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, rows``: a table an upload, its lines in order of id: a row of the article, then one of code, quantity, price and amount; behind them the total and a line that is none."""
    at = lambda text, x, i: F.struct(text.alias("text"), F.lit(1.0).alias("conf"), F.lit(0).alias("page"), F.lit(x + 10.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(float(x)).alias("left"), F.lit(i).alias("idx"))
    lefts = (100, 420, 500, 600, 720)
    row = lambda *cells: F.array(*(at(F.lit(c) if isinstance(c, str) else c, x, i) for i, (c, x) in enumerate(cells)))
    money = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    pair = F.array(row((F.col("article"), 100)), row((F.col("code"), 420), (F.concat("pieces", F.lit(" pcs")), 500), (money("price"), 600), (money("amount"), 720)))
    lines = rendered_lines(spark, d).groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("line_id", pair.alias("pair")))).alias("l"))
    head = F.array(row(*zip(("Description", "HSN", "Quantity", "Rate", "Amount"), lefts)))
    tail = F.array(row(("Total 12.00", 100)), row(("ghost", 100), ("1.00", 720)))
    return lines.select(F.col("upload_id").alias("doc_id"), F.concat(head, F.flatten(F.transform("l", lambda x: x["pair"])), tail).alias("rows"))
