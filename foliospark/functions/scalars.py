"""Scalar expressions over text, amounts and boxes.  All are plain Column expressions; nulls give null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
# Units in a quantity text, the longest spelling first.
QUANTITY_UNITS = ("pieces", "piece", "carton", "litre", "meter", "bags", "bag", "boxes", "box", "nos", "pcs", "pc", "kg", "ml", "cm", "g", "l", "m")
AMOUNT = r"(?<![\d,.])\d[\d,]*\.\d{2}(?!\d)"
GSTIN = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9]Z[A-Z0-9]$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def center(bbox: Column) -> Column:
    """struct(cx, cy): the mean corner of a box given as points."""
    n = F.size(bbox)
    mean = lambda i: F.when(n > 0, F.aggregate(F.transform(bbox, lambda p: F.get(p, F.lit(i))), F.lit(0.0), lambda a, x: a + x) / n)
    return F.struct(mean(0).alias("cx"), mean(1).alias("cy"))


def extent(bbox: Column) -> Column:
    """struct(left, top, right, bottom) of a box given as points."""
    xs, ys = F.transform(bbox, lambda p: F.get(p, F.lit(0))), F.transform(bbox, lambda p: F.get(p, F.lit(1)))
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"))


def area(bbox: Column) -> Column:
    """Width by height of a box given as points."""
    e = extent(bbox)
    return (e["right"] - e["left"]) * (e["bottom"] - e["top"])


def hull(boxes: Column) -> Column:
    """The four-point box around an array of boxes."""
    e = extent(F.flatten(boxes))
    return F.array(F.array(e["left"], e["top"]), F.array(e["right"], e["top"]), F.array(e["right"], e["bottom"]), F.array(e["left"], e["bottom"]))


def confidence(conf: Column, other: Column) -> Column:
    """The first of two confidences that is set and not 0, else 1."""
    return F.coalesce(F.nullif(conf, F.lit(0.0)), F.nullif(other, F.lit(0.0)), F.lit(1.0))


def amount(text: Column) -> Column:
    """An amount from text with currency signs and group commas; null if what is left is no number."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("decimal(20,4)").cast(MONEY)


def amount_in_text(text: Column) -> Column:
    """The last amount with two decimals in a text, else its last decimal number; none in texts that speak of per cent."""
    last = lambda p: F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.lit(-1))
    return F.when(~text.rlike("(?i)%|percent"), amount(F.coalesce(last(AMOUNT), last(r"\d+\.\d+"))))


def first_number(text: Column) -> Column:
    """The first number of a text, group commas aside, as double."""
    return F.regexp_extract(F.regexp_replace(text, ",", ""), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def quantity_unit(text: Column) -> Column:
    """The unit word of a quantity text, matched as a word."""
    t = F.regexp_replace(F.lower(text), r"([0-9])([a-z])", "$1 $2")
    return F.nullif(F.regexp_extract(t, r"\b(" + "|".join(QUANTITY_UNITS) + r")\b", 1), F.lit(""))


def spaced_quantity(text: Column) -> Column:
    """A quantity text with a blank between figures and letters."""
    return F.regexp_replace(text, r"([0-9])([A-Za-z])", "$1 $2")


def rate(value: Column, default: float = 0.18) -> Column:
    """A tax rate as a fraction: values over 1 are per cent, nulls the default."""
    return F.coalesce(F.when(value > 1, value / 100).otherwise(value), F.lit(default))


def split_rate(rate_pct: Column, default: float = 18.0) -> Column:
    """struct of the two halves of a tax rate in per cent."""
    half = F.coalesce(rate_pct, F.lit(default)) / 2
    return F.struct(half.alias("cgstRatePct"), half.alias("sgstRatePct"))


def iso_date(text: Column) -> Column:
    """A day-first date as ISO text; other texts stay as they are.  Two-digit years from 69 on are of the last century."""
    parts = [F.regexp_extract(text, r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})$", i) for i in (1, 3, 4)]
    year = F.when(F.length(parts[2]) == 4, parts[2].try_cast("int")).otherwise(F.when(parts[2].try_cast("int") >= 69, 1900).otherwise(2000) + parts[2].try_cast("int"))
    padded = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(parts[1], 2, "0"), F.lpad(parts[0], 2, "0"))
    return F.coalesce(F.try_to_date(padded, "yyyy-MM-dd").cast("string"), text)


def group1(pattern: str, text: Column) -> Column:
    """The trimmed first group of a pattern's first match, or null."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


# Labels of headers and footers that end a description.
NOISE_LABELS = ("HSN/SAC", r"Invoice No\.?", "Tax Invoice", "This is a Computer Generated Invoice", "continued to page number", r"E\.&\s*O\.E", "GSTIN", "Amount Chargeable")


def clean_description(text: Column) -> Column:
    """A description without what a header's or footer's label begins, blanks single; empty gives null."""
    t = F.regexp_replace(text, r"(?i)\b(?:" + "|".join(NOISE_LABELS) + r")\b.*", "")
    return F.nullif(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def valid_gstin(text: Column) -> Column:
    """Whether a text has the form of a tax number."""
    return F.coalesce(text.rlike(GSTIN), F.lit(False))


def sha256(content: Column) -> Column:
    """Hex digest of binary content."""
    return F.sha2(content, 256)


# Patterns of personal data.
PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"(?:\+91)?[6-9][0-9]{9}", "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"}


def personal(kind: str, text: Column) -> Column:
    """All e-mail addresses, phone numbers or tax account numbers in a text."""
    return F.regexp_extract_all(text, F.lit(PERSONAL[kind]), F.lit(0))
