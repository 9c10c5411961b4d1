"""Header, party and total fields out of text.  Text has one row of tokens a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.scalars import amount, group1, iso_date, let

_SIGN = r"[\s:]*(?:₹|Rs\.?)?\s*"
_MONEY = _SIGN + r"([0-9][0-9,]*\.?[0-9]{0,2})"
# Labels of printed totals.
TOTAL_PATTERNS = {
    "subTotal": r"(?i)\bsubtotal\b" + _MONEY, "taxableValue": r"(?i)\b(?:taxable\s+(?:value|amount)|total\s+before\s+tax)\b" + _MONEY, "printedTax": r"(?i)\b(?:total\s+tax|gst\s+total)\b(?:\s+amount)?" + _MONEY,
    "cgst": r"(?i)\bcgst\b\s*(?:@?\s*[0-9.]+\s*%)?" + _MONEY, "sgst": r"(?i)\bsgst\b\s*(?:@?\s*[0-9.]+\s*%)?" + _MONEY, "igst": r"(?i)\bigst\b\s*(?:@?\s*[0-9.]+\s*%)?" + _MONEY,
}
#: A whole number without a sign behind Total is a quantity, not an amount.
GRAND_TOTAL = r"(?i)\b(?:grand\s+)?total\b(?:\s+amount)?(?:\s*:?\s*(?:₹|Rs\.?)\s*|\s*:\s*|\s+(?=[0-9,]*\.[0-9]))([0-9][0-9,]*\.?[0-9]{0,2})"
NUMBER = r"(?im)\binvoice\s*(?:no|number|#)\s*\.?\s*[:\-]?\s*([A-Z0-9][A-Z0-9/\-]*\d[A-Z0-9/\-]*|\d+)"
_DAY = r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}[- ][A-Za-z]{3}[- ]\d{2,4}|\d{4}-\d{2}-\d{2})"
DATE = r"(?i)(?<!ack )(?<!reference )\b(?:date|dated)\b\s*[:\-]?\s*" + _DAY
PLACE = r"(?im)\bplace\s+of\s+supply\b\s*[:\-]?\s*([A-Za-z][A-Za-z .]*)"
GSTIN = r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z])\b"
PHONE = r"((?:\+91[\s-]?)?[6-9][0-9]{9})"


def totals(text: Column) -> Column:
    """struct of printed totals; a round-off keeps its sign, the words and the total quantity come along.

    The total is the last that is no sub total and has a sign or decimals; the tax is the printed one, else that of its halves.
    """
    t = F.regexp_replace(text, r"(?i)sub\s*total", "subtotal")

    def build(t: Column) -> Column:
        found = {k: amount(group1(p, t)) for k, p in TOTAL_PATTERNS.items()}
        off = F.regexp_extract(t, r"(?i)round(?:ed|ing)?\s*-?\s*off\s*[:₹]?\s*(-?)\s*₹?\s*([0-9]+\.[0-9]{1,2})", 0)
        sign = F.when(off.rlike(r"(?i)off\s*[:₹]?\s*-"), -1).otherwise(1)
        value = amount(F.regexp_extract(off, r"([0-9]+\.[0-9]{1,2})", 1))
        whole = amount(F.try_element_at(F.regexp_extract_all(t, F.lit(GRAND_TOTAL), F.lit(1)), F.lit(-1)))
        tax = F.coalesce(found["printedTax"], F.when(found["cgst"].isNotNull() | found["sgst"].isNotNull(), (F.coalesce(found["cgst"], F.lit(0)) + F.coalesce(found["sgst"], F.lit(0))).cast("decimal(18,2)")), found["igst"])
        words = lambda label: group1(r"(?i)\b" + label + r"\b[ \t]*(?:\(in words\))?[\s:-]*([^\n]+)", t)
        return F.struct(
            *(found[k].alias(k) for k in ("subTotal", "taxableValue", "cgst", "sgst", "igst")), whole.alias("totalAmount"), tax.alias("totalTax"), (value * sign).cast("decimal(18,2)").alias("roundOff"),
            group1(r"(?im)^\s*total\s+(\d+(?:\s*[A-Za-z]+)?)\s*$", t).alias("totalQty"), F.coalesce(words("(?:amount chargeable|invoice amount in words)"), group1(r"(?im)^(.*\brupees?\b.*)$", t)).alias("totalInWords"),
            words("tax amount in words").alias("taxInWords"),
        )

    return let(t, build)


def header(text: Column) -> Column:
    """struct of an invoice's number, dates, place of supply, reference, registration number and acknowledgement."""
    raw = group1(DATE, text)
    return F.struct(
        group1(NUMBER, text).alias("number"), iso_date(raw).alias("date"), raw.alias("dateRaw"), group1(PLACE, text).alias("placeOfSupply"),
        group1(r"(?i)\breference\s+(?:no|number)\b\.?\s*[:\-]?\s*([A-Z0-9][A-Z0-9/\-]*)", text).alias("referenceNo"), iso_date(group1(r"(?i)\breference\b[^\n]*?" + _DAY, text)).alias("referenceDate"),
        group1(r"(?i)\birn\b\s*[:.\-]?\s*([0-9a-f][0-9a-f\-]{9,})", text).alias("irn"),
        group1(r"(?i)\back(?:nowledgement)?\b\.?\s*(?:no\b\.?)?\s*[:\-]?\s*([0-9]+)\b(?![/-])", text).alias("ackNo"), iso_date(group1(r"(?i)\back(?:nowledgement)?\s+date\b\s*[:\-]?\s*" + _DAY, text)).alias("ackDate"),
    )


_STATE = r"(?i)\bstate\s+name\s*[:\-]?\s*([A-Za-z ]+?)\s*,?\s*code\s*[:\-]?\s*[0-9]{2}"
_CODE = r"(?i)\bstate\s+name\b[^\n]*?\bcode\s*[:\-]?\s*([0-9]{2})"


def seller(text: Column) -> Column:
    """struct(name, gstin, state, stateCode, unit): the party named before the buyer's block."""
    head = F.regexp_replace(text, r"(?is)\bbill(?:ed)?\s+to\b.*$", "")
    name = F.coalesce(group1(r"(?im)^\s*M/s\.?\s*[:\-]?\s*(.+)$", head), group1(r"(?im)^\s*For\s*[:\-]\s*(.+)$", head))
    return F.struct(
        F.regexp_replace(name, r"\s+", " ").alias("name"), group1(GSTIN, head).alias("gstin"), group1(_STATE, head).alias("state"), group1(_CODE, head).alias("stateCode"), group1(r"(?im)\bunit\s+of\s+(.+)$", head).alias("unit"),
    )


def buyer(text: Column) -> Column:
    """struct(name, gstin, phone, state, stateCode, contact) of the block behind Bill To; without one, the second tax number."""
    block = F.regexp_extract(text, r"(?is)\bbill(?:ed)?\s+to\b[\s:]*(.*?)(?:#?\s*item\s+name|description\s+of\s+goods|invoice\s+(?:details|no\b)|\z)", 1)
    second = F.try_element_at(F.regexp_extract_all(text, F.lit(GSTIN), F.lit(1)), F.lit(2))
    return let(block, lambda b: F.struct(
        group1(r"(?m)^\s*(.+)$", b).alias("name"), F.coalesce(group1(GSTIN, b), second).alias("gstin"), group1(PHONE, b).alias("phone"), group1(_STATE, b).alias("state"), group1(_CODE, b).alias("stateCode"),
        F.coalesce(group1(r"(?im)^(.*\b[SDW]/O\b.*)$", b), group1(r"(?im)^\s*contact(?:\s+no)?\s*[.:]*\s*(.+)$", b)).alias("contact"),
    ))


# How sure a party's place among the clusters of tokens is.
SELLER_CONFIDENCE, BUYER_CONFIDENCE = 0.8, 0.6


def header_blocks(tokens: Column, labels: Column) -> Column:
    """struct(seller, buyer, invoice) of a page's ``tokens`` (text, bbox, conf) with their cluster ``labels``: the first cluster is the seller's block, the second the buyer's.

    A party's name is the first text of its block without a tax number; tax numbers come in order of the page; an address is what else stands in the block.  Values found in the text
    bring along box and confidence of the first token that holds them.
    """
    labelled = F.transform(F.coalesce(tokens, F.array()), lambda t, i: F.struct(F.trim(t["text"]).alias("text"), t["bbox"].alias("bbox"), t["conf"].alias("conf"), F.get(labels, i).alias("label")))

    def build(ts: Column) -> Column:
        texts = F.transform(ts, lambda t: t["text"])
        joined = F.concat_ws(" | ", texts)
        numbers = F.regexp_extract_all(F.upper(joined), F.lit(GSTIN), F.lit(1))
        holder = lambda value: F.try_element_at(F.filter(ts, lambda t: F.contains(F.upper(t["text"]), F.upper(value))), F.lit(1))

        def party(label: int, at: int, confidence: float) -> Column:
            own = F.filter(ts, lambda t: t["label"] == label)
            first = F.try_element_at(F.filter(own, lambda t: (F.length(t["text"]) > 0) & ~F.upper(t["text"]).rlike(GSTIN)), F.lit(1))
            gstin = F.try_element_at(numbers, F.lit(at))
            return let(F.struct(first.alias("first"), gstin.alias("gstin")), lambda x: F.struct(
                x["first"]["text"].alias("name"), x["gstin"].alias("gstin"), address_near(F.transform(own, lambda t: t["text"]), x["first"]["text"], x["gstin"]).alias("address"),
                F.lit(confidence).alias("confidence"), F.coalesce(x["first"]["bbox"], holder(x["gstin"])["bbox"]).alias("bbox"),
            ))

        number, day, place = group1(NUMBER, joined), group1(r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b", joined), group1(PLACE, joined)
        sure = lambda value: F.coalesce(holder(value)["conf"], F.when(value.isNotNull(), F.lit(0.7)).otherwise(F.lit(0.0)))
        return F.struct(
            party(0, 1, SELLER_CONFIDENCE).alias("seller"), party(1, 2, BUYER_CONFIDENCE).alias("buyer"),
            F.struct(
                let(number, lambda v: F.struct(v.alias("value"), sure(v).alias("confidence"), holder(v)["bbox"].alias("bbox"))).alias("number"),
                let(day, lambda v: F.struct(iso_date(v).alias("value"), sure(v).alias("confidence"), v.alias("raw"))).alias("date"), place.alias("placeOfSupply"),
            ).alias("invoice"),
        )

    return let(labelled, build)


def document_meta(texts: Column) -> Column:
    """struct(documentType, isComputerGenerated, authorisedSignatory) of the token texts in order."""
    low = lambda t: F.lower(t)
    return F.struct(
        F.try_element_at(F.filter(texts, lambda t: F.contains(low(t), F.lit("invoice"))), F.lit(1)).alias("documentType"),
        F.exists(texts, lambda t: F.contains(low(t), F.lit("computer generated"))).alias("isComputerGenerated"),
        F.try_element_at(F.filter(texts, lambda t: low(t).rlike(r"m/s|\bfor\b")), F.lit(-1)).alias("authorisedSignatory"),
    )


def address_near(texts: Column, name: Column, gstin: Column) -> Column:
    """A party's texts without its name, its tax number and labels."""
    kept = F.filter(texts, lambda t: (t != F.coalesce(name, F.lit(""))) & ~F.contains(t, F.coalesce(gstin, F.lit("\u0000"))) & ~F.lower(t).rlike(r"^\s*(?:seller|buyer|bill to|ship to|from|to)\s*:?\s*$"))
    return F.nullif(F.concat_ws(" ", kept), F.lit(""))


def text_items(text: Column) -> Column:
    """Lines between the item heading and the totals."""
    lines = F.split(text, "\n")
    begin = F.array_position(F.transform(lines, lambda x: F.lower(x).rlike(r"item\s+name|description\s+of\s+goods|particulars")), True).cast("int")
    return F.when(begin > 0, F.slice(lines, begin + 1, F.greatest(F.size(lines) - begin, F.lit(0)))).otherwise(lines)
