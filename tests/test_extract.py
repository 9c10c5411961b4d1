"""The documented invoice of the fixtures, end to end."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from foliospark.operators.extract import extract_invoices
from foliospark.schemas import OCR_DOCUMENT

G1 = """Invoice No.: 297 @100,50,200,70|Date: 20-08-2025 @100,80,200,100|For: RANG MAHAL @100,120,250,140
SHASTRI NAGAR MADHEPURA MADHEPURA @100,150,350,170|GSTIN: 10CKXPK7984A1ZV @100,180,280,200|Bill To @100,220,150,240
SHREE RAM IRON @100,250,220,270|RAHUL KUMAR, S/O RAJESH KUMAR @100,280,320,300|AGRAWAL WARD NO-20, SUBHASH CHOWK, MADHEPURA @100,310,400,330
Contact No: +917779886449 @100,340,280,360|GSTIN Number: 10FVYPK2595A1ZG @100,370,320,390|# Item name @100,420,200,440
1 NATURAL GYPSUM CALCINED PLASTER @100,450,380,470|2520 @100,480,150,500|149 Bag @200,480,270,500|₹ 263.00 @300,480,380,500
₹ 39,187.00 @400,480,500,500|(5.0%) @520,480,580,500|Invoice Amount In Words @100,530,300,550
Forty One Thousand One Hundred and Forty Six Rupees only @100,560,500,580|Sub Total ₹ 39,187.00 @100,610,280,630|SGST@2.5% ₹ 979.68 @100,640,250,660
CGST@2.5% ₹ 979.68 @100,670,250,690|Round off - ₹ 0.35 @100,700,230,720|Total ₹ 41,146.00 @100,730,250,750|Total 149 @100,760,180,780"""


def tokens(text):
    out = []
    for part in text.replace("\n", "|").split("|"):
        t, _, box = part.rpartition(" @")
        l, top, r, b = map(float, box.split(","))
        out.append((t.strip(), [[l, top], [r, top], [r, b], [l, b]], None, None, None, None))
    return out


def test_documented_invoice(spark):
    docs = spark.createDataFrame([(1, tokens(G1)), (2, []), (3, None)], OCR_DOCUMENT)
    rows = {r["doc_id"]: r for r in extract_invoices(docs).collect()}
    r = rows[1]
    assert r["invoice"]["number"] == "297" and r["invoice"]["dateRaw"] == "20-08-2025" and r["invoice"]["date"] == "2025-08-20"
    assert (r["seller"]["name"], r["seller"]["gstin"]) == ("RANG MAHAL", "10CKXPK7984A1ZV")
    assert (r["buyer"]["name"], r["buyer"]["gstin"], r["buyer"]["phone"]) == ("SHREE RAM IRON", "10FVYPK2595A1ZG", "+917779886449")
    assert [tuple(x) for x in r["items"]] == [("NATURAL GYPSUM CALCINED PLASTER", "2520", "149 Bag", D("263.00"), D("39187.00"))]
    t = r["totals"]
    assert (t["subTotal"], t["cgst"], t["sgst"], t["totalAmount"], t["roundOff"], t["totalQty"]) == (D("39187.00"), D("979.68"), D("979.68"), D("41146.00"), D("-0.35"), "149")
    assert rows[2]["items"] == [] and rows[3]["items"] == []


def test_wrapped_lines_make_one_item(spark):
    lines = "# Item name @100,50,200,70|1 NATURAL GYPSUM @100,100,300,120|CALCINED PLASTER 2520 @100,140,300,160|149 Bag 263.00 39,187.00 @100,180,400,200|Total @100,220,150,240"
    docs = spark.createDataFrame([(1, tokens(lines))], OCR_DOCUMENT)
    r = extract_invoices(docs).first()
    assert len(r["items"]) == 1 and r["items"][0]["quantity"] == "149 Bag" and r["items"][0]["taxableValue"] == D("39187.00")
    assert r["items"][0]["hsn"] == "2520"


def test_no_shuffle(spark):
    docs = spark.createDataFrame([(1, tokens(G1))], OCR_DOCUMENT)
    plan = extract_invoices(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
