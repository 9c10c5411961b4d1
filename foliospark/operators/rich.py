"""Lines with confidences, boxes and raw text, from token columns or table cells, and the whole response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.scalars import first_number, hull, let, quantity_unit, rate
from foliospark.operators import fields
from foliospark.operators.clusters import best_centers
from foliospark.operators.quality import line_warnings, warnings
from foliospark.operators.reconcile import line_amounts, reconciled, split_tax
from foliospark.operators.table import nearest_center
from foliospark.operators.tokens import below_header, geometry_tokens, row_bucket, rows_by_average

SKIP = r"(?i)description|\bqty\b|quantity|\bamount\b|\btotal\b|subtotal|\bs\.?no\b|\bsr\.?no\b"


def mean_confidence(tokens: Column) -> Column:
    """Mean confidence of an array of tokens, missing ones as 0.5; 0 without tokens."""
    total = F.aggregate(tokens, F.lit(0.0), lambda a, t: a + F.coalesce(t["conf"], F.lit(0.5)))
    return F.when(F.size(tokens) > 0, total / F.size(tokens)).otherwise(F.lit(0.0))


def field_of(tokens: Column) -> Column:
    """struct(value, confidence, raw) of the texts of some tokens."""
    return let(F.trim(F.concat_ws(" ", F.transform(tokens, lambda t: t["text"]))), lambda t: F.struct(F.nullif(t, F.lit("")).alias("value"), mean_confidence(tokens).alias("confidence"), t.alias("raw")))


def rich_line(columns: Column) -> Column:
    """A line from its columns of tokens: description, code, quantity, price and rate by place.

    The first column is the description, with the second unless that is a code; without figures a number is missing, not 0.
    """
    at = lambda i: F.coalesce(F.get(columns, F.lit(i)), F.slice(F.get(columns, F.lit(0)), 1, 0))

    def build(c: Column) -> Column:
        code = F.regexp_extract(c["second"]["raw"], r"(?<!\d)(\d{4,8})(?!\d)", 1)
        return F.struct(
            F.when(code == "", F.trim(F.concat_ws(" ", c["first"]["value"], c["second"]["value"]))).otherwise(c["first"]["value"]).alias("description"), c["first"]["confidence"].alias("description_conf"),
            F.nullif(code, F.lit("")).alias("hsn"), first_number(c["third"]["raw"]).alias("qty"), quantity_unit(c["third"]["raw"]).alias("unit"), c["third"]["raw"].alias("qty_raw"), c["third"]["confidence"].alias("qty_conf"),
            first_number(c["fourth"]["raw"]).alias("unitPrice"), c["fourth"]["confidence"].alias("price_conf"), rate(first_number(c["fifth"]["raw"])).alias("gstRate"), c["fifth"]["confidence"].alias("gst_conf"),
        )

    return let(F.struct(*(field_of(at(i)).alias(n) for i, n in enumerate(("first", "second", "third", "fourth", "fifth")))), build)


def column_centers_of(rows: Column, most: int = 5) -> Column:
    """Centres of at most ``most`` columns of a table's rows: the exact ones of all tokens in rows of two or more that are no header or total; 0 without such rows."""
    text = lambda r: F.concat_ws(" ", F.transform(r, lambda t: t["text"]))
    table = F.filter(rows, lambda r: (F.size(r) >= 2) & ~text(r).rlike(SKIP))
    xs = F.filter(F.transform(F.flatten(table), lambda t: t["cx"]), lambda x: x.isNotNull())
    found = F.pandas_udf(lambda column: column.map(lambda x: best_centers(x, most)), "array<double>")
    return F.when(F.size(xs) > 0, found(xs)).otherwise(F.array(F.lit(0.0)))


def lines_from_rows(rows: Column, centers: Column) -> Column:
    """Lines of rows of tokens: each token goes to the nearest centre; header and total rows, and rows without description or quantity, are left out."""
    columns = lambda r: F.transform(F.sequence(F.lit(0), F.greatest(F.size(centers) - 1, F.lit(0))), lambda i: F.filter(r, lambda t: nearest_center(t["cx"], centers) == i))
    text = lambda r: F.concat_ws(" ", F.transform(r, lambda t: t["text"]))
    lines = F.transform(F.filter(rows, lambda r: ~text(r).rlike(SKIP)), lambda r: let(columns(r), rich_line))
    return F.filter(lines, lambda x: x["description"].isNotNull() & (F.coalesce(x["qty"], F.lit(0.0)) > 0))


LINE_ROWS = ("description", "hsn", "qty", "unit", "unitPrice", "gstRate")


def extract_tables(documents: DataFrame, cells: DataFrame | None = None, band: float = 0.3) -> DataFrame:
    """``doc_id, source, row, description, hsn, qty, unit, unitPrice, gstRate``: the lines of documents' tables, by the cheapest way that yields any.

    ``documents`` has ``doc_id, fullText, height``, the height of the page (null: the lowest token's).  A document whose recognised ``cells`` (as ``lines_from_cells``) give lines takes those.  Of the others the tokens
    below the header band make rows by running average, columns by exact centres, and lines by nearest centre.
    """
    t = documents.select("doc_id", geometry_tokens(F.col("fullText"), page_drop=float("inf")).alias("t"), "height")
    if cells is not None:
        found = lines_from_cells(cells).select("doc_id", F.lit("cells").alias("source"), "row", *LINE_ROWS)
        t = t.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    height = F.coalesce(F.col("height").cast("double"), F.array_max(F.transform("t", lambda x: x["cy"])))
    t = t.select("doc_id", rows_by_average(below_header(F.col("t"), height, band)).alias("rows"))
    t = t.select("doc_id", "rows", column_centers_of(F.col("rows")).alias("centers")).select("doc_id", F.posexplode(lines_from_rows(F.col("rows"), F.col("centers"))).alias("row", "x"))
    out = t.select("doc_id", F.lit("tokens").alias("source"), "row", *(F.col(f"x.{c}").alias(c) for c in LINE_ROWS))
    return out if cells is None else found.unionByName(out)


def lines_from_cells(cells: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines of recognised table cells (``bbox`` of four numbers, ``text``, ``conf``), one a row of cells.

    Cells go to rows by their height to ten, and to columns by their left edge; texts of figures alone take quantity, price and rate in that order.
    """
    mid = (F.get("bbox", F.lit(1)) + F.get("bbox", F.lit(3))) / 2
    placed = cells.where("bbox is not null and text is not null").select(doc, row_bucket(mid).alias("row"), F.struct(F.get("bbox", F.lit(0)).alias("left"), "text", "conf").alias("c"))
    grouped = placed.groupBy(doc, "row").agg(F.array_sort(F.collect_list("c")).alias("cells"))
    text = F.concat_ws(" ", F.transform("cells", lambda c: c["text"]))
    grouped = grouped.where(~text.rlike(SKIP))
    number = lambda c: F.regexp_replace(c["text"], "[₹,%\\s]", "").rlike(r"^\d+(?:\.\d+)?(?:[A-Za-z]+\.?)?$")
    words = F.filter("cells", lambda c: ~number(c))
    code = F.filter("cells", lambda c: c["text"].rlike(r"^\s*\d{4,8}\s*$"))
    figures = F.filter("cells", lambda c: number(c) & ~c["text"].rlike(r"^\s*\d{4,8}\s*$"))
    value = lambda i: first_number(F.get(figures, F.lit(i))["text"])
    out = grouped.select(
        doc, "row", F.nullif(F.trim(F.concat_ws(" ", F.transform(words, lambda c: c["text"]))), F.lit("")).alias("description"), F.trim(F.get(code, F.lit(0))["text"]).alias("hsn"),
        value(0).alias("qty"), quantity_unit(F.get(figures, F.lit(0))["text"]).alias("unit"), value(1).alias("unitPrice"), rate(value(2)).alias("gstRate"), mean_confidence(F.col("cells")).alias("confidence"),
    )
    return out.where("description is not null and qty > 0")


def hull_of(tokens: Column) -> Column:
    """The box around an array of tokens with boxes."""
    return hull(F.transform(tokens, lambda t: t["bbox"]))


def build_responses(documents: DataFrame) -> DataFrame:
    """Whole responses of documents with ``doc_id, text, lines`` (as ``rich_line``), ``focus, glare, ocr_confidence, upload_hash, phash``; ``tail``, if there, is the text with the totals.

    Lines are recomputed, printed totals of the text take precedence over computed ones, and what is doubtful is listed.
    """
    money = "decimal(18,2)"
    d = documents.withColumn("computed", F.transform("lines", lambda x: line_amounts(x["qty"], x["unitPrice"], x["gstRate"])))
    total = lambda k: F.aggregate("computed", F.lit(0).cast(money), lambda a, x: (a + F.coalesce(x[k], F.lit(0).cast(money))).cast(money))
    d = d.withColumn("sums", F.struct(*(total(k).alias(k) for k in ("net", "tax", "gross")))).withColumn("printed", fields.totals(F.col("tail" if "tail" in documents.columns else "text"))).withColumn("header", fields.header(F.col("text")))
    split = split_tax(F.col("sums.tax"), F.col("header.placeOfSupply"))
    none = F.col("printed.cgst").isNull() & F.col("printed.sgst").isNull() & F.col("printed.igst").isNull()
    checked = reconciled(F.col("sums.gross"), F.col("printed.totalAmount"))
    totals = F.struct(
        F.coalesce("printed.subTotal", "sums.net").alias("net"), F.coalesce("printed.totalTax", "sums.tax").alias("tax"), F.coalesce("printed.totalAmount", "sums.gross").alias("gross"),
        *(F.when(none, split[k]).otherwise(F.col(f"printed.{k}")).alias(k) for k in ("cgst", "sgst", "igst")), checked["reconciled"].alias("reconciled"), F.coalesce("printed.roundOff", checked["delta"]).alias("roundOffDelta"),
    )
    found = F.concat(warnings(F.col("focus"), F.col("glare"), F.when(F.col("header.number").isNull(), F.lit(0.0)).otherwise(F.lit(0.8))), line_warnings(F.col("lines")))
    meta = F.struct(F.col("ocr_confidence").alias("ocrConfidence"), F.struct("focus", "glare").alias("quality"), F.lit(False).alias("duplicateLikely"), F.col("upload_hash").alias("uploadHash"), "phash")
    return d.select("doc_id", meta.alias("meta"), fields.seller(F.col("text")).alias("seller"), fields.buyer(F.col("text")).alias("buyer"), F.col("header").alias("invoice"), F.arrays_zip("lines", "computed").alias("lines"), totals.alias("totals"), found.alias("warnings"))
