"""Queries over the nested responses and recorded quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.nested import child_records, label_nodes
from foliospark.operators.quantities import normalize_quantities, recorded_history, unit_factors, unit_shifts
from foliospark.runtime import read_table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child records of every stored response."""
    return child_records(label_nodes(read_table(spark, sf_dir, "ocr_responses")))


def p4_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node table with interval labels and bodies."""
    return label_nodes(read_table(spark, sf_dir, "ocr_responses"), with_body=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in base units."""
    return normalize_quantities(read_table(spark, sf_dir, "line_items"), read_table(spark, sf_dir, "unit_codes"))


def p5_unit_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level shifts in the recorded quantities of each vendor and article."""
    lines = read_table(spark, sf_dir, "line_items").dropDuplicates(["line_id"])
    article = F.regexp_replace(F.lower(F.regexp_replace("description", r"^\d+ ", "")), r"^(\S+ \S+).*$", "$1")
    recorded = lines.select(
        F.concat_ws("|", F.coalesce(F.col("vendor_id").cast("string"), F.lit("-")), F.coalesce(article, F.lit("-"))).alias("source"), F.col("line_id").alias("at"), "qty_value", "qty_raw"
    )
    factors = unit_factors(read_table(spark, sf_dir, "unit_codes"))
    known = sorted({float(f) for _, f, _ in factors.values() if f > 1})
    return unit_shifts(recorded_history(recorded, factors), known)


QUERIES = {"p4_found": p4_found, "p4_nodes": p4_nodes, "p5_found": p5_found, "p5_unit_shifts": p5_unit_shifts}
