"""Recomputed lines, totals and what they reconcile to.  Money is decimal, rounded half up; shares are multiplied, never divided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.scalars import MONEY


def money(c: Column) -> Column:
    return c.cast(MONEY)


def line_amounts(qty: Column, price: Column, rate: Column) -> Column:
    """struct(net, tax, gross) of a line."""
    net = F.round(qty.cast(MONEY) * price.cast(MONEY), 2).cast(MONEY)
    tax = F.round(net * rate.cast("decimal(9,4)"), 2).cast(MONEY)
    return F.struct(net.alias("net"), tax.alias("tax"), (net + tax).cast(MONEY).alias("gross"))


def summarize(lines: DataFrame, key: str) -> DataFrame:
    """Sums of net, tax and gross of each document; partial sums before the shuffle."""
    return lines.groupBy(key).agg(*(F.sum(c).cast(MONEY).alias(c) for c in ("net", "tax", "gross")), F.count("*").alias("n_lines"))


def reconciled(computed_gross: Column, printed_gross: Column, tolerance: float = 1.0) -> Column:
    """struct(reconciled, delta): printed less computed, within tolerance; without a printed total nothing is amiss."""
    delta = F.when(printed_gross.isNull(), F.lit(0).cast(MONEY)).otherwise((money(printed_gross) - money(computed_gross)).cast(MONEY))
    return F.struct((F.abs(delta) <= tolerance).alias("reconciled"), delta.alias("delta"))


def split_tax(tax: Column, place_of_supply: Column) -> Column:
    """struct(cgst, sgst, igst): all to igst where a place of supply is named, else halves."""
    half = F.round(money(tax) * F.lit("0.5").cast("decimal(2,1)"), 2).cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    there = place_of_supply.isNotNull()
    return F.struct(F.when(there, zero).otherwise(half).alias("cgst"), F.when(there, zero).otherwise(half).alias("sgst"), F.when(there, money(tax)).otherwise(zero).alias("igst"))


def first_total(printed: Column, computed: Column) -> Column:
    """The printed figure where there is one, else the computed."""
    return F.coalesce(money(printed), money(computed))


def mend_price(price: Column, taxable: Column, quantity: Column) -> Column:
    """struct(price, taxable) of a line with a whole ``quantity``: a missing price from taxable by quantity; both swapped if the price is over twice the taxable.

    A line whose price by quantity is within 5 % of its taxable stays as it is, as does one without a quantity.
    """
    p, t = money(price), money(taxable)
    n = quantity.cast("int")
    counted = F.coalesce(n > 0, F.lit(False)) & F.coalesce(t != 0, F.lit(False))
    gone = p.isNull() | (p == 0)
    near = F.abs(p * n - t).cast("double") / (t.cast("double") + 1e-6) < 0.05
    swap = counted & ~gone & ~near & (p > 2 * t)
    derived = F.round(t / F.nullif(n, F.lit(0)).cast("decimal(10,0)"), 2).cast(MONEY)
    return F.struct(F.when(counted & gone, derived).when(swap, t).otherwise(p).alias("price"), F.when(swap, p).otherwise(t).alias("taxable"))


# The rates that goods and services are taxed at.
ALLOWED_RATES = ("0", "0.05", "0.12", "0.18", "0.28")


def allowed_rate(rate: Column) -> Column:
    """Whether a tax rate, as a fraction, is one of those that exist; null for null."""
    return rate.cast("decimal(9,4)").isin(*(F.lit(r).cast("decimal(9,4)") for r in ALLOWED_RATES))


def special_line(text: Column) -> Column:
    """discount, round_off or freight for lines that are no items, else null."""
    t = F.lower(text)
    return (
        F.when(t.rlike(r"\bdisc(ount)?\b"), "discount").when(t.rlike(r"\bround(ed|ing)?[ -]?off\b"), "round_off").when(t.rlike(r"freight|transport|shipping"), "freight")
    )


def tax_errors(items_taxable: Column, taxable: Column, cgst: Column, sgst: Column, tax: Column, gstin: Column) -> Column:
    """Codes of what doesn't add up in a document."""
    gap = lambda a, b: F.abs(a - b) > F.lit("0.01").cast(MONEY)
    codes = F.array(
        F.when(~F.coalesce(gstin.rlike(r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9]Z[A-Z0-9]$"), F.lit(False)), "BAD_GSTIN"),
        F.when(gap(items_taxable, taxable), "TAXABLE_MISMATCH"), F.when(gap(cgst + sgst, tax), "TAX_MISMATCH"),
    )
    return F.filter(codes, lambda c: c.isNotNull())


def item_totals(items: Column) -> Column:
    """struct(totalAmount, totalQty) of an array of flat items: the sum of taxable values, and of the quantities' first whole numbers in pieces."""
    amount = F.aggregate(items, F.lit(0).cast(MONEY), lambda a, x: (a + F.coalesce(x["taxableValue"].cast(MONEY), F.lit(0).cast(MONEY))).cast(MONEY))
    pieces = F.aggregate(items, F.lit(0), lambda a, x: a + F.coalesce(F.regexp_extract(x["quantity"], r"(\d+)", 1).try_cast("int"), F.lit(0)))
    return F.struct(amount.alias("totalAmount"), F.when(pieces > 0, F.concat(pieces.cast("string"), F.lit(" PCS"))).alias("totalQty"))


def line_sums(lines: DataFrame, key: str, taxable: Column, quantity: Column) -> DataFrame:
    """``key, total_amount, total_qty`` of line rows: as ``item_totals``, summed partially before the shuffle, so a document of any length takes no more than its sums."""
    whole = F.coalesce(F.regexp_extract(quantity, r"(\d+)", 1).try_cast("int"), F.lit(0))
    sums = lines.groupBy(key).agg(F.sum(F.coalesce(money(taxable), F.lit(0).cast(MONEY))).cast(MONEY).alias("total_amount"), F.sum(whole).alias("_n"))
    return sums.select(key, "total_amount", F.when(F.col("_n") > 0, F.concat(F.col("_n").cast("string"), F.lit(" PCS"))).alias("total_qty"))
