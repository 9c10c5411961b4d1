"""Fixed schemas of tokens, lines and documents."""

from __future__ import annotations

TOKEN = "text string, bbox array<array<double>>, conf double, confidence double, handwritten boolean, hw_score double"
FIELD = "value: {0}, confidence: double, bbox: array<array<double>>, alts: array<{0}>, raw: string"
QTY = f"{FIELD.format('double')}, unit: string"
ENTITY = "name: string, gstin: string, address: string, confidence: double, bbox: array<array<double>>"
COMPUTED = "net: decimal(18,2), tax: decimal(18,2), gross: decimal(18,2)"
QUALITY = "focus: double, glare: double, skewDeg: double, resolution: array<int>"
META = f"ocrConfidence: double, quality: struct<{QUALITY}>, duplicateLikely: boolean, uploadHash: string, phash: string"
INVOICE = "number: struct<value: string, confidence: double, bbox: array<array<double>>, alt: array<string>>, date: struct<value: string, confidence: double, raw: string>, placeOfSupply: string"
TOTALS = "net: double, tax: double, gross: double, cgst: double, sgst: double, igst: double, confidence: double, reconciled: boolean, roundOffDelta: double"
LINE = f"rowId: string, description: struct<{FIELD.format('string')}>, hsn: string, qty: struct<{QTY}>, unitPrice: struct<{FIELD.format('double')}>, gstRate: struct<{FIELD.format('double')}>, computed: struct<{COMPUTED}>"
RESPONSE = (
    f"meta struct<{META}>, seller struct<{ENTITY}>, buyer struct<{ENTITY}>, invoice struct<{INVOICE}>, lines array<struct<{LINE}>>, totals struct<{TOTALS}>, "
    "warnings array<struct<code: string, field: string, score: double>>, fullText array<struct<text: string, confidence: double, bbox: array<array<double>>, handwritten: boolean, hw_score: double>>"
)
#: A document of tokens as it arrives.
OCR_DOCUMENT = f"doc_id bigint, fullText array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in TOKEN.split(', '))}>>"
#: A line item of the structured result.
FLAT_ITEM = "description string, hsn string, quantity string, unitPrice decimal(18,2), taxableValue decimal(18,2)"
