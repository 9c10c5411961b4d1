"""Documents assembled from their rows, and views for other systems."""

from __future__ import annotations

import platform

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.scalars import MONEY, group1


def assemble(heads: DataFrame, lines: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``heads`` with their ``lines`` as one ordered array of structs, numbered r1, r2, ...; documents without lines get an empty array."""
    cols = [c for c in lines.columns if c not in (key, *order)]
    grouped = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *cols))).alias("_l"))
    numbered = F.transform("_l", lambda x, i: F.struct(F.concat(F.lit("r"), (i + 1).cast("string")).alias("rowId"), *(x[c].alias(c) for c in (*order, *cols))))
    joined = heads.join(grouped, key, "left")
    kind = joined.select(numbered.alias("x")).schema["x"].dataType.simpleString()
    return joined.withColumn("lines", F.coalesce(numbered, F.array().cast(kind))).drop("_l")


def accounting_entries(documents: DataFrame, key: str, net: str, cgst: str, sgst: str, igst: str, gross: str) -> DataFrame:
    """Debit and credit rows of each document: goods and taxes against the supplier."""
    row = lambda account, debit, credit: F.struct(F.lit(account).alias("account"), debit.cast(MONEY).alias("debit"), credit.cast(MONEY).alias("credit"))
    zero = F.lit(0)
    rows = F.array(
        row("Purchases", F.col(net), zero), row("Input CGST", F.col(cgst), zero), row("Input SGST", F.col(sgst), zero), row("Input IGST", F.col(igst), zero), row("Creditors", zero, F.col(gross)),
    )
    return documents.select(key, F.explode(rows).alias("e")).select(key, "e.*").where("debit != 0 or credit != 0")


def average_confidence(lines: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Mean of several confidences over all rows of a document, summed in thousandths; missing ones count 0.5."""
    total = sum((F.coalesce(F.nanvl(F.col(f), F.lit(None).cast("double")), F.lit(0.5)) for f in fields), F.lit(0.0))
    return lines.groupBy(key).agg((F.sum(F.round(total * 1000).cast("bigint")) / (1000 * len(fields) * F.count("*"))).alias("avg_confidence"))


def overlay(tokens: DataFrame, places: int = 2) -> DataFrame:
    """Labelled boxes for drawing: document, place, box and text with confidence."""
    return tokens.select("doc_id", "idx", "x0", "y0", "x1", "y1", F.format_string(f"%s (%.{places}f)", "text", "conf").alias("label"))


def extraction_accuracy(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Share of expected rows found, per document, in per cent; documents nothing was expected of give null."""
    counts = expected.groupBy(key).agg(F.count("*").alias("expected_rows")).join(found.groupBy(key).agg(F.count("*").alias("found_rows")), key, "left").na.fill(0, ["found_rows"])
    return counts.select(key, "expected_rows", "found_rows", F.round(F.col("found_rows") * 100 / F.nullif(F.col("expected_rows"), F.lit(0)), 1).alias("accuracy"))


def better_description(description: Column, texts: Column) -> Column:
    """The first text that looks like a product's name (capitals, figures, blanks and stops, 4 to 29 signs) and contains the description or stands in it, else the description."""
    named = F.filter(texts, lambda t: t.rlike(r"^[A-Z0-9\s.]+$") & F.length(t).between(4, 29) & (F.contains(description, t) | F.contains(t, description)))
    return F.coalesce(F.try_element_at(named, F.lit(1)), description)


def item_view(lines: Column, texts: Column) -> Column:
    """Numbered items of an array of rich lines (``description, qty, unit, unitPrice, gstRate, hsn``): quantity with unit, rate, taxable value and the halves of the tax rate in per cent.

    What a line lacks is null; no unit counts pieces.  ``texts`` are the page's, of which a better description is taken.
    """

    def item(x: Column, i: Column) -> Column:
        per = F.upper(F.coalesce(F.nullif(x["unit"], F.lit("")), F.lit("PCS")))
        half = (x["gstRate"].cast("decimal(9,4)") * F.lit(50)).cast("decimal(9,2)")
        value = (x["qty"].cast(MONEY) * x["unitPrice"].cast(MONEY)).cast(MONEY)
        return F.struct(
            (i + 1).alias("slNo"), better_description(x["description"], texts).alias("description"), F.concat_ws(" ", F.floor(x["qty"]).cast("string"), per).alias("quantity"), x["unitPrice"].cast(MONEY).alias("rate"), per.alias("per"),
            value.alias("taxableValue"), x["hsn"].alias("hsn"), half.alias("cgstRate"), half.alias("sgstRate"),
        )

    return F.transform(lines, item)


def party_view(name: Column, gstin: Column, address: Column, texts: Column, role: str) -> Column:
    """struct of a seller or buyer as other systems expect it: state and its code out of the texts, the unit of a seller, the contact of a buyer."""
    stated = F.try_element_at(F.filter(texts, lambda t: t.rlike(r"(?i)\bcode\s*:\s*\d{2}")), F.lit(1))
    extra = (
        F.try_element_at(F.filter(texts, lambda t: F.contains(t, F.lit("Unit of"))), F.lit(1)).alias("unit") if role == "seller" else F.try_element_at(F.filter(texts, lambda t: F.lower(t).contains("s/o")), F.lit(1)).alias("contact")
    )
    return F.struct(
        name.alias("name"), address.alias("address"), gstin.alias("gstin"), group1(r"(?i)([A-Za-z][A-Za-z ]*?)\s*,\s*code\s*:", stated).alias("state"), group1(r"(?i)\bcode\s*:\s*(\d{2})", stated).alias("stateCode"), extra,
    )


def engine_info(spark: SparkSession) -> DataFrame:
    """``component, version`` of what the engine runs on."""
    import numpy
    import pandas
    import pyarrow

    found = {"spark": spark.version, "python": platform.python_version(), "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__}
    return spark.createDataFrame(sorted(found.items()), "component string, version string")
