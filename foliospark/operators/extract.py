"""Structured invoices from documents of tokens: the whole path from boxes to items, parties and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.operators import fields
from foliospark.operators.reconcile import item_totals, mend_price
from foliospark.operators.table import ITEM, find_header, is_transposed, merge_lines, parse_table, parse_transposed, valid_items
from foliospark.operators.tokens import full_text, geometry_tokens, row_text, rows_by_median, stitch


def extract_invoices(documents: DataFrame, config: Config | None = None, keep_text: bool = False) -> DataFrame:
    """One structured row a document: ``doc_id``, invoice, seller, buyer, items, totals, meta, tier.

    ``documents`` has ``doc_id`` and ``fullText``.  Header and parties come from the first page, totals from the last.  Items come from the table, transposed if its fields are rows; where that yields none, from lines of text.
    Everything is a projection: no shuffle.  Documents without tokens give nulls and no items.
    """
    c = config or Config()
    d = documents.select("doc_id", geometry_tokens(F.col("fullText")).alias("tokens"))
    d = d.select("doc_id", "tokens", rows_by_median(F.col("tokens"), c.row_tolerance).alias("rows"))
    d = d.select("doc_id", "tokens", "rows", find_header(F.col("rows")).alias("found"), full_text(F.col("rows")).alias("text"), stitch(F.col("rows")).alias("pages"))
    rows = F.col("rows")
    table = F.when(is_transposed(rows), parse_transposed(rows)).otherwise(parse_table(rows, F.col("found"), c.column_margin, c.least_column_width))
    d = d.withColumn("from_table", valid_items(table))
    lines = F.filter(fields.text_items(F.col("text")), lambda x: F.length(F.trim(x)) > 0)
    d = d.withColumn("from_text", F.when(F.size("from_table") == 0, valid_items(merge_lines(lines))))
    items = F.when(F.size("from_table") > 0, F.col("from_table")).otherwise(F.coalesce("from_text", F.array().cast(f"array<{ITEM}>")))
    d = d.withColumn("items", F.transform(items, _mended)).withColumn("t", fields.totals(F.col("pages.tail"))).withColumn("s", item_totals(F.col("items")))
    total = F.when(F.col("t.totalAmount").isNull() | (F.col("t.totalAmount") < 100), F.nullif(F.col("s.totalAmount"), F.lit(0).cast("decimal(18,2)"))).otherwise(F.col("t.totalAmount"))
    totals = F.col("t").withField("totalAmount", F.coalesce(total, F.col("t.totalAmount"))).withField("totalQty", F.coalesce("t.totalQty", "s.totalQty"))
    out = d.select(
        "doc_id", fields.header(F.col("pages.head")).alias("invoice"), fields.seller(F.col("pages.head")).alias("seller"), fields.buyer(F.col("pages.head")).alias("buyer"), "items", totals.alias("totals"),
        fields.document_meta(F.transform("tokens", lambda t: t["text"])).alias("meta"),
        F.when(F.size("from_table") > 0, "table").when(F.size("items") > 0, "text").otherwise("none").alias("tier"), *(["text"] if keep_text else []),
    )
    return out


def _mended(x):  # noqa: ANN001, ANN202
    quantity = F.regexp_extract(x["quantity"], r"(\d+)", 1).try_cast("int")
    m = mend_price(x["unitPrice"], x["taxableValue"], quantity)
    return F.struct(x["description"].alias("description"), F.nullif(F.regexp_extract(x["hsn"], r"(\d{4,8})", 1), F.lit("")).alias("hsn"), x["quantity"].alias("quantity"), m["price"].alias("unitPrice"), m["taxable"].alias("taxableValue")).cast(ITEM)


def explode_items(structured: DataFrame) -> DataFrame:
    """One row an item, numbered from 1."""
    return structured.select("doc_id", F.posexplode("items").alias("p", "x")).select("doc_id", (F.col("p") + 1).alias("slNo"), "x.*")


def document_rows(documents: DataFrame, tolerance: float = 16.0) -> DataFrame:
    """One row a text row: ``doc_id, row_idx, text``."""
    rows = rows_by_median(geometry_tokens(F.col("fullText")), tolerance)
    return documents.select("doc_id", F.posexplode(rows).alias("row_idx", "row")).select("doc_id", "row_idx", row_text(F.col("row")).alias("text"))
