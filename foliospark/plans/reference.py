"""Queries of the document and invoice operators, each with its SQL.

Page lines of ``documents`` serve as tokens: line i of a text has the box ``line_boxes[i]``.  Orders with their lines serve as invoices, and so do uploads, whose invoices are written
out as text and read back.  Of a redelivered key one row counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import scalars as S
from foliospark.operators import assemble as A
from foliospark.operators import fields as P
from foliospark.operators import quality as Q
from foliospark.operators import reconcile as R
from foliospark.operators import rich as H
from foliospark.operators import table as T
from foliospark.operators import tokens as K
from foliospark.operators.clusters import cluster_labels, cluster_tokens, column_centers
from foliospark.operators.extract import explode_items, extract_invoices
from foliospark.plans.rendered import RENDERED_SQL, WRITTEN_SQL, once, once_sql, rendered_invoices, rendered_lines, rendered_tables
from foliospark.runtime import read_table
from foliospark.sources.readers import stored_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MONEY = S.MONEY


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with its SQL if SQL can express it."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def invoice_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders with price and tax; the number of parts is far below that of lines, so Spark chooses how to join."""
    li, p = read_table(spark, d, "lineitem"), read_table(spark, d, "part").select("p_partkey", "p_retailprice")
    amounts = R.line_amounts(F.col("l_quantity"), F.col("p_retailprice"), F.col("l_tax"))
    return li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", amounts.alias("a")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "a.*")


LINES_SQL = """
lines as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, net, tax, cast(net + tax as decimal(18,2)) as gross from (
  select *, cast(round(net * cast(l_tax as decimal(9,4)), 2) as decimal(18,2)) as tax from (
    select *, cast(round(cast(l_quantity as decimal(18,2)) * cast(p_retailprice as decimal(18,2)), 2) as decimal(18,2)) as net from lineitem join part on l_partkey = p_partkey)))"""
SUMS_SQL = LINES_SQL + """,
sums as (select l_orderkey, cast(sum(net) as decimal(18,2)) as net, cast(sum(tax) as decimal(18,2)) as tax, cast(sum(gross) as decimal(18,2)) as gross, count(*) as n_lines from lines group by 1)"""


@query(f"with {LINES_SQL} select * from lines")
def line_totals(spark: SparkSession, d: str) -> DataFrame:
    return invoice_lines(spark, d)


@query(f"with {SUMS_SQL} select * from sums")
def order_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.summarize(invoice_lines(spark, d), "l_orderkey")


@query(f"with {LINES_SQL} select cast(sum(net) as decimal(18,2)) as net, cast(sum(tax) as decimal(18,2)) as tax, cast(sum(gross) as decimal(18,2)) as gross, count(*) as n_lines from lines")
def grand_totals(spark: SparkSession, d: str) -> DataFrame:
    return invoice_lines(spark, d).agg(*(F.sum(c).cast(MONEY).alias(c) for c in ("net", "tax", "gross")), F.count("*").alias("n_lines"))


@query(f"""select upload_id, case when place_of_supply is null then h else 0.00 end as cgst, case when place_of_supply is null then h else 0.00 end as sgst, case when place_of_supply is null then 0.00 else t end as igst
from (select upload_id, place_of_supply, cast(tax_total as decimal(18,2)) as t, cast(round(cast(tax_total as decimal(18,2)) * cast(0.5 as decimal(2,1)), 2) as decimal(18,2)) as h from {once_sql("invoices", "upload_id", "tax_total", "place_of_supply")})""")
def split_tax(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "invoices", "upload_id", "tax_total", "place_of_supply").select("upload_id", R.split_tax(F.col("tax_total"), F.col("place_of_supply")).alias("s")).select("upload_id", "s.*")


@query(f"""with {SUMS_SQL} select o_orderkey, abs(delta) <= 1.0 as reconciled, delta from (
select o_orderkey, case when o_totalprice is null then cast(0 as decimal(18,2)) else cast(cast(o_totalprice as decimal(18,2)) - gross as decimal(18,2)) end as delta from orders join sums on o_orderkey = l_orderkey)""")
def reconcile_orders(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    s = R.summarize(invoice_lines(spark, d), "l_orderkey")
    return o.join(s, o.o_orderkey == s.l_orderkey).select("o_orderkey", R.reconciled(F.col("gross"), F.col("o_totalprice")).alias("r")).select("o_orderkey", "r.*")


HEAD = ("net_total", "tax_total", "gross_total", "cgst", "sgst", "igst")
INVOICE_SUMS_SQL = f"""once as {once_sql("invoices", "upload_id", *HEAD)},
item as (select upload_id, cast(sum(cast(net_amount as decimal(18,2))) as decimal(18,2)) as net, cast(sum(cast(tax_amount as decimal(18,2))) as decimal(18,2)) as tax, cast(sum(cast(gross_amount as decimal(18,2))) as decimal(18,2)) as gross
 from {once_sql("line_items", "line_id", "upload_id", "net_amount", "tax_amount", "gross_amount")} group by 1)"""


def _printed(spark: SparkSession, d: str) -> DataFrame:
    """One row an upload: printed totals and the sums of its lines."""
    li = once(spark, d, "line_items", "line_id", "upload_id", "net_amount", "tax_amount", "gross_amount")
    sums = li.groupBy("upload_id").agg(*(F.sum(F.col(f"{c}_amount").cast(MONEY)).cast(MONEY).alias(c) for c in ("net", "tax", "gross")))
    return once(spark, d, "invoices", "upload_id", *HEAD).join(sums, "upload_id", "left")


@query(f"""with {INVOICE_SUMS_SQL} select upload_id, coalesce(cast(net_total as decimal(18,2)), net) as net, coalesce(cast(tax_total as decimal(18,2)), tax) as tax, coalesce(cast(gross_total as decimal(18,2)), gross) as gross from once left join item using (upload_id)""")
def totals_precedence(spark: SparkSession, d: str) -> DataFrame:
    return _printed(spark, d).select("upload_id", *(R.first_total(F.col(f"{c}_total"), F.col(c)).alias(c) for c in ("net", "tax", "gross")))


@query(f"""with {INVOICE_SUMS_SQL} select upload_id, abs(cast(gross_total as decimal(18,2)) - gross) <= 1.0 as reconciled, cast(cast(gross_total as decimal(18,2)) - gross as decimal(18,2)) as delta from once join item using (upload_id) where gross_total is not null and gross is not null""")
def reconcile_invoices(spark: SparkSession, d: str) -> DataFrame:
    p = _printed(spark, d).where("gross_total is not null and gross is not null")
    return p.select("upload_id", R.reconciled(F.col("gross"), F.col("gross_total")).alias("r")).select("upload_id", "r.*")


@query(f"""with {INVOICE_SUMS_SQL} select upload_id, not coalesce(regexp_full_match(vendor_gstin, '{S.GSTIN[1:-1]}'), false) as bad_gstin, coalesce(abs(net - cast(net_total as decimal(18,2))) > 0.01, false) as taxable_mismatch,
coalesce(abs(cast(cgst as decimal(18,2)) + cast(sgst as decimal(18,2)) - cast(tax_total as decimal(18,2))) > 0.01, false) as tax_mismatch from once left join item using (upload_id)
left join {once_sql("uploads", "upload_id", "vendor_id")} u using (upload_id) left join vendors v on u.vendor_id = v.vendor_id""")
def tax_validation(spark: SparkSession, d: str) -> DataFrame:
    m = lambda c: F.col(c).cast(MONEY)
    p = _printed(spark, d).join(once(spark, d, "uploads", "upload_id", "vendor_id"), "upload_id", "left").join(read_table(spark, d, "vendors").select("vendor_id", "vendor_gstin"), "vendor_id", "left")
    codes = R.tax_errors(F.col("net"), m("net_total"), m("cgst"), m("sgst"), m("tax_total"), F.col("vendor_gstin"))
    return p.select("upload_id", *(F.array_contains(codes, c.upper()).alias(c) for c in ("bad_gstin", "taxable_mismatch", "tax_mismatch")))


# Hundredths are divided as whole numbers: as doubles some halves would be rounded down.
@query(f"""select line_id, case when n > 0 and t <> 0 and coalesce(p, 0) = 0 then cast(sign(t) * ((2 * abs(cast(t * 100 as bigint)) + n) // (2 * n)) * cast(0.01 as decimal(3,2)) as decimal(18,2)) when swap then t else p end as price, case when swap then p else t end as taxable from (
select *, coalesce(n > 0 and t <> 0 and p <> 0 and not abs(cast(p * n - t as double)) / (cast(t as double) + 1e-6) < 0.05 and p > 2 * t, false) as swap from (
select line_id, cast(unit_price as decimal(18,2)) as p, cast(net_amount as decimal(18,2)) as t, try_cast(nullif(regexp_extract(qty_value, '([0-9]+)', 1), '') as int) as n from {once_sql("line_items", "line_id", "unit_price", "net_amount", "qty_value")}))""")
def fix_unit_tax(spark: SparkSession, d: str) -> DataFrame:
    mended = R.mend_price(F.col("unit_price"), F.col("net_amount"), F.regexp_extract("qty_value", "([0-9]+)", 1).try_cast("int"))
    return once(spark, d, "line_items", "line_id", "unit_price", "net_amount", "qty_value").select("line_id", mended.alias("m")).select("line_id", "m.price", "m.taxable")


@query(rf"select line_id, cast(try_cast(regexp_replace(qty_value, '[^0-9.\-]', '', 'g') as decimal(20,4)) as decimal(18,2)) as amount from {once_sql('line_items', 'line_id', 'qty_value')}")
def normalize_amount(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "line_items", "line_id", "qty_value").select("line_id", S.amount(F.col("qty_value")).alias("amount"))


@query(rf"select line_id, try_cast(nullif(regexp_extract(replace(qty_raw, ',', ''), '([0-9]+(?:\.[0-9]+)?)', 1), '') as double) as number from {once_sql('line_items', 'line_id', 'qty_raw')}")
def first_number(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "line_items", "line_id", "qty_raw").select("line_id", S.first_number(F.col("qty_raw")).alias("number"))


@query(f"""select line_id, rate, case when gst_rate is not null then cast(rate as decimal(9,4)) in (0, 0.05, 0.12, 0.18, 0.28) end as allowed
from (select line_id, gst_rate, coalesce(case when gst_rate > 1 then gst_rate / 100 else gst_rate end, 0.18) as rate from {once_sql("line_items", "line_id", "gst_rate")})""")
def gst_normalize(spark: SparkSession, d: str) -> DataFrame:
    r = once(spark, d, "line_items", "line_id", "gst_rate").withColumn("rate", S.rate(F.col("gst_rate")))
    return r.select("line_id", "rate", F.when(F.col("gst_rate").isNotNull(), R.allowed_rate(F.col("rate"))).alias("allowed"))


@query(rf"select line_id, nullif(regexp_extract(regexp_replace(lower(qty_value), '([0-9])([a-z])', '\1 \2', 'g'), '\b(" + "|".join(S.QUANTITY_UNITS) + rf")\b', 1), '') as unit from {once_sql('line_items', 'line_id', 'qty_value')}")
def qty_unit(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "line_items", "line_id", "qty_value").select("line_id", S.quantity_unit(F.col("qty_value")).alias("unit"))


@query(rf"""select upload_id, invoice_date_raw, coalesce(cast(try_cast(case when regexp_full_match(invoice_date_raw, '\d{{1,2}}[/-]\d{{1,2}}[/-](\d{{4}}|\d{{2}})') then
 (case when length(y) = 4 then y when cast(y as int) >= 69 then '19' || y else '20' || y end) || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') end as date) as varchar), invoice_date_raw) as iso from (
select *, regexp_extract(invoice_date_raw, '^(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}}|\d{{2}})$', 1) as dd, regexp_extract(invoice_date_raw, '^(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}}|\d{{2}})$', 2) as m, regexp_extract(invoice_date_raw, '^(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}}|\d{{2}})$', 3) as y
from {once_sql("invoices", "upload_id", "invoice_date_raw")})""")
def date_normalize(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "invoices", "upload_id", "invoice_date_raw").select("upload_id", "invoice_date_raw", S.iso_date(F.col("invoice_date_raw")).alias("iso"))


@query(f"select entity_id, coalesce(regexp_full_match(gstin, '{S.GSTIN[1:-1]}'), false) as valid from {once_sql('entities', 'entity_id', 'gstin')}")
def gstin_check(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "entities", "entity_id", "gstin").select("entity_id", S.valid_gstin(F.col("gstin")).alias("valid"))


# A description with a footer's label run into it, one of several by the line's number.
LABELS = (" HSN/SAC 4820 GST", "  Tax Invoice 5", " this is a computer generated invoice", " GSTIN 10AB", " Amount Chargeable (in words) Ten", " E.& O.E", "", " Continued to page number 2")


@query(f"""with {WRITTEN_SQL} select line_id, article as description from written""")
def clean_description(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions with labels run into them, cleaned: what is left is what was written."""
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("line_id") % len(LABELS) + 1).cast("int"))
    return rendered_lines(spark, d).select("line_id", S.clean_description(F.concat(F.regexp_replace("article", " ", "   "), label)).alias("description"))


@query(f"""with {RENDERED_SQL} select upload_id, special, count(*) as n from (
select upload_id, 'discount' as special from inv where round_off_delta is not null union all select upload_id, 'round_off' from inv where round_off_delta is not null union all select upload_id, 'freight' from inv) group by 1, 2""")
def special_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of written invoices that are no items."""
    lines = rendered_invoices(spark, d).select("upload_id", F.explode("texts").alias("text")).select("upload_id", R.special_line(F.col("text")).alias("special"))
    return lines.where("special is not null").groupBy("upload_id", "special").agg(F.count("*").alias("n"))


@query(f"select line_id, coalesce(net_amount, 0) <> 0 or coalesce(unit_price, 0) <> 0 or coalesce(hsn, '') <> '' as valid from {once_sql('line_items', 'line_id', 'net_amount', 'unit_price', 'hsn')}")
def item_validity(spark: SparkSession, d: str) -> DataFrame:
    money = lambda c: F.col(c).cast("decimal(20,4)")
    items = F.array(F.struct(money("net_amount").alias("taxableValue"), money("unit_price").alias("unitPrice"), F.col("hsn").alias("hsn")))
    return once(spark, d, "line_items", "line_id", "net_amount", "unit_price", "hsn").select("line_id", (F.size(T.valid_items(items)) > 0).alias("valid"))


QUALITY = ("mime_type", "size_bytes", "focus", "glare", "res_width", "res_height", "ocr_confidence", "upload_hash", "phash")
GATE_SQL = f"""gate as (select *, not coalesce(ok, false) and not coalesce(pdf, false) as reject from (select *, mime_type = 'application/pdf' as pdf,
case when mime_type not in ('image/png', 'image/jpeg', 'application/pdf') or mime_type is null then 'unsupported' when size_bytes > 12 * 1024 * 1024 then 'too_large' else 'ok' end as status,
greatest(res_width, res_height) >= case when mime_type = 'application/pdf' then 1400 else 1600 end and focus >= case when mime_type = 'application/pdf' then 50 else 80 end and glare <= case when mime_type = 'application/pdf' then 0.12 else 0.08 end as ok
from {once_sql("uploads", "upload_id", *QUALITY)}))"""


@query(f"with {GATE_SQL} select upload_id, status, coalesce(ok, false) as ok, reject from gate")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    u = once(spark, d, "uploads", "upload_id", *QUALITY)
    g = Q.gate(F.col("mime_type"), F.col("focus"), F.col("glare"), F.col("res_width"), F.col("res_height"))
    return u.select("upload_id", Q.upload_status(F.col("mime_type"), F.col("size_bytes")).alias("status"), g["ok"].alias("ok"), g["reject"].alias("reject"))


@query(f"""with {GATE_SQL} select upload_id, outcome, case when outcome = 'bad_quality' then 'BAD_QUALITY' when outcome = 'read' and pdf and not coalesce(ok, false) then 'LOW_QUALITY_PDF' end as code,
case when outcome = 'bad_quality' then '' when outcome = 'read' then upload_hash end as upload_hash, case when outcome = 'bad_quality' then 0.0 when outcome = 'read' then ocr_confidence end as confidence
from (select *, case when status <> 'ok' then status when reject then 'bad_quality' when upload_id % 7 = 0 then 'no_text' else 'read' end as outcome from gate)""")
def short_results(spark: SparkSession, d: str) -> DataFrame:
    """What uploads are answered before they are read: the refused, the rejected in short, those without text (every seventh here), poor PDFs with a warning."""
    g = Q.gated(once(spark, d, "uploads", "upload_id", *QUALITY), F.when(F.col("upload_id") % 7 == 0, 0).otherwise(5))
    return g.select("upload_id", "outcome", F.get("warnings", F.lit(0))["code"].alias("code"), F.col("meta.uploadHash").alias("upload_hash"), F.col("meta.ocrConfidence").alias("confidence"))


@query(f"""select upload_id, unnest(list_filter([case when focus < 80 then 'LOW_FOCUS' end, case when glare > 0.08 then 'HIGH_GLARE' end, case when ocr_confidence < 0.7 then 'LOW_CONF_FIELD' end], lambda x: x is not null)) as code from {once_sql("uploads", "upload_id", "focus", "glare", "ocr_confidence")}""")
def document_warnings(spark: SparkSession, d: str) -> DataFrame:
    u = once(spark, d, "uploads", "upload_id", "focus", "glare", "ocr_confidence")
    return u.select("upload_id", F.explode(Q.warnings(F.col("focus"), F.col("glare"), F.col("ocr_confidence"))).alias("w")).select("upload_id", "w.code")


@query("select sha256(text) as sha, count(*) as n, min(doc_id) as first_key from documents where text is not null group by 1 having count(*) > 1")
def sha_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return Q.same_content(read_table(spark, d, "documents").where("text is not null"), "doc_id", F.encode("text", "UTF-8"))


@query("select doc_id, sha256(text) as sha from documents")
def upload_hash(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", S.sha256(F.encode("text", "UTF-8")).alias("sha"))


def page_tokens(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, idx, text, conf``, box, centre and left edge of every line of every page."""
    docs = read_table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("t"), "line_boxes")
    lines = docs.select("doc_id", F.posexplode(F.arrays_zip("t", "line_boxes")).alias("idx", "z")).where("z.t is not null and z.line_boxes is not null")
    t = lines.select("doc_id", "idx", F.col("z.t").alias("text"), "z.line_boxes.*").withColumn("conf", F.round(F.col("conf").cast("double"), 3))
    return t.select("doc_id", "idx", "text", "conf", "x0", "y0", "x1", "y1", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.col("x0").cast("double").alias("left"))


TOK_SQL = r"""tok as (select doc_id, i - 1 as idx, t[i] as text, round(cast(line_boxes[i].conf as double), 3) as conf, line_boxes[i].x0 as x0, line_boxes[i].y0 as y0, line_boxes[i].x1 as x1, line_boxes[i].y1 as y1,
 (line_boxes[i].x0 + line_boxes[i].x1) / 2 as cx, (line_boxes[i].y0 + line_boxes[i].y1) / 2 as cy, cast(line_boxes[i].x0 as double) as "left"
 from (select doc_id, t, line_boxes, unnest(range(1, least(len(t), len(line_boxes)) + 1)) as i from (select doc_id, string_split(text, chr(10)) as t, line_boxes from documents)))"""


@query(f'with {TOK_SQL} select doc_id, idx, cx, cy, "left", cast((x1 - x0) * (y1 - y0) as double) as area from tok')
def token_geometry(spark: SparkSession, d: str) -> DataFrame:
    p = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    box = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))
    t = page_tokens(spark, d).select("doc_id", "idx", box.alias("bbox"))
    return t.select("doc_id", "idx", S.center(F.col("bbox"))["cx"].alias("cx"), S.center(F.col("bbox"))["cy"].alias("cy"), S.extent(F.col("bbox"))["left"].alias("left"), S.area(F.col("bbox")).alias("area"))


@query(f"with {TOK_SQL} select doc_id, idx, text from tok where cx between 100 and 400 and cy between 100 and 600")
def tokens_in_region(spark: SparkSession, d: str) -> DataFrame:
    return K.in_region(page_tokens(spark, d), 100, 100, 400, 600).select("doc_id", "idx", "text")


@query(f"with {TOK_SQL} select doc_id, idx, text from (select *, max(y0) over (partition by doc_id) as most from tok) where y0 > 0.8 * most")
def tokens_at_bottom(spark: SparkSession, d: str) -> DataFrame:
    return K.bottom_share(page_tokens(spark, d), top="y0").select("doc_id", "idx", "text")


@query(f"with {TOK_SQL} select doc_id, idx, conf from tok where conf < 0.7")
def low_confidence(spark: SparkSession, d: str) -> DataFrame:
    return page_tokens(spark, d).where("conf < 0.7").select("doc_id", "idx", "conf")


@query(f"with {TOK_SQL} select doc_id, idx, text from tok where contains(lower(text), 'market')")
def search_text(spark: SparkSession, d: str) -> DataFrame:
    return page_tokens(spark, d).where(F.contains(F.lower("text"), F.lit("market"))).select("doc_id", "idx", "text")


@query(f"""with {TOK_SQL} select doc_id, idx, cast(sum(case when prev > 0 and cy < prev - 100 then 1 else 0 end) over (partition by doc_id order by idx) as int) as page from (select *, lag(cy) over (partition by doc_id order by idx) as prev from tok)""")
def page_breaks(spark: SparkSession, d: str) -> DataFrame:
    return K.page_breaks(page_tokens(spark, d), drop=100.0).select("doc_id", "idx", "page")


@query(f"with {TOK_SQL} select doc_id, idx, cast(round_even(cy / 10, 0) * 10 as int) as bucket from tok")
def row_bucket(spark: SparkSession, d: str) -> DataFrame:
    return page_tokens(spark, d).select("doc_id", "idx", K.row_bucket(F.col("cy")).alias("bucket"))


def page_documents(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their tokens as one sorted array."""
    docs = read_table(spark, d, "documents").select("doc_id", F.arrays_zip(F.split("text", "\n").alias("t"), F.col("line_boxes").alias("b")).alias("z"))
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    box = lambda b: F.array(point(b["x0"], b["y0"]), point(b["x1"], b["y0"]), point(b["x1"], b["y1"]), point(b["x0"], b["y1"]))
    token = lambda z: F.struct(z["t"].alias("text"), F.when(z["t"].isNotNull() & z["b"].isNotNull(), box(z["b"])).alias("bbox"), F.round(z["b"]["conf"].cast("double"), 3).alias("conf"), F.lit(None).cast("double").alias("confidence"))
    return docs.select("doc_id", F.transform("z", token).alias("fullText"))


@query(f"""with recursive {TOK_SQL},
num as (select doc_id, idx, cy, row_number() over (partition by doc_id order by cy, "left", idx) as rn from tok where trim(text) <> ''),
fold as (select doc_id, idx, rn, [cy] as cur, 0 as row_idx from num where rn = 1
 union all select n.doc_id, n.idx, n.rn, case when abs(n.cy - list_median(f.cur)) <= 16 then list_append(f.cur, n.cy) else [n.cy] end, case when abs(n.cy - list_median(f.cur)) <= 16 then f.row_idx else f.row_idx + 1 end
 from fold f join num n on n.doc_id = f.doc_id and n.rn = f.rn + 1)
select doc_id, idx, row_idx from fold""")
def rows_by_median(spark: SparkSession, d: str) -> DataFrame:
    t = page_documents(spark, d).select("doc_id", K.geometry_tokens(F.col("fullText"), page_drop=1e9).alias("t"))
    r = t.select("doc_id", F.posexplode(K.rows_by_median(F.col("t"))).alias("row_idx", "r"))
    return r.select("doc_id", F.explode("r").alias("x"), "row_idx").select("doc_id", F.col("x.idx").alias("idx"), "row_idx")


@query(f"""with recursive {TOK_SQL},
num as (select doc_id, idx, cy, row_number() over (partition by doc_id order by cy, "left", idx) as rn from tok where trim(text) <> ''),
fold as (select doc_id, idx, rn, cast(cy as double) as y, 0 as row_idx from num where rn = 1
 union all select n.doc_id, n.idx, n.rn, case when abs(n.cy - f.y) < 30 then (f.y + n.cy) / 2 else n.cy end, case when abs(n.cy - f.y) < 30 then f.row_idx else f.row_idx + 1 end
 from fold f join num n on n.doc_id = f.doc_id and n.rn = f.rn + 1)
select doc_id, idx, row_idx from fold""")
def rows_by_average(spark: SparkSession, d: str) -> DataFrame:
    t = page_documents(spark, d).select("doc_id", K.geometry_tokens(F.col("fullText"), page_drop=1e9).alias("t"))
    r = t.select("doc_id", F.posexplode(K.rows_by_average(F.col("t"))).alias("row_idx", "r"))
    return r.select("doc_id", F.explode("r").alias("x"), "row_idx").select("doc_id", F.col("x.idx").alias("idx"), "row_idx")


# Overlapping columns of a page, by left and right edge.
BOUNDS = ((-1e6, 212.0), (188.0, 412.0), (388.0, 612.0), (588.0, 800.0))


@query(f"""with {TOK_SQL} select doc_id, idx, case when cx <= 212 then 0 when cx <= 412 then 1 when cx <= 612 then 2 else 3 end as col from tok""")
def assign_columns(spark: SparkSession, d: str) -> DataFrame:
    bounds = F.array(*(F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for a, b in BOUNDS))
    return page_tokens(spark, d).select("doc_id", "idx", T.column_of(F.col("cx"), bounds).alias("col"))


@query(f"""with {TOK_SQL} select doc_id, idx, cast(list_position(ds, list_min(ds)) - 1 as int) as col from (select doc_id, idx, [abs(cx - 150.0), abs(cx - 300.0), abs(cx - 450.0)] as ds from tok)""")
def nearest_column(spark: SparkSession, d: str) -> DataFrame:
    return page_tokens(spark, d).select("doc_id", "idx", T.nearest_center(F.col("cx"), F.array(*map(F.lit, (150.0, 300.0, 450.0)))).alias("col"))


SCORE_SQL = " + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in T.HEADER_WORDS)


@query(f"with {TOK_SQL} select doc_id, idx, {SCORE_SQL} as score from tok")
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    return page_tokens(spark, d).select("doc_id", "idx", T.keyword_score(F.col("text")).alias("score"))


FACTS_SQL = rf'''facts as (select doc_id, i - 1 as idx, lower(l) as text, len(string_split(l, ' ')) as n, {SCORE_SQL.replace("text", "l")} as score, len(regexp_extract_all(l, '\d+(?:[.,]\d+)*')) as numbers, len(regexp_extract_all(l, '\d+\.\d+')) as decimals
 from (select doc_id, i, t[i] as l from (select doc_id, t, unnest(range(1, len(t) + 1)) as i from (select doc_id, string_split(text, chr(10)) as t from documents))))'''


def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """Pages with each line as a row and its words as tokens."""
    token = lambda w, i: F.struct(w.alias("text"), F.lit(1.0).alias("conf"), F.lit(0).alias("page"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("left"), i.alias("idx"))
    rows = F.transform(F.split("text", "\n"), lambda line: F.transform(F.split(line, " "), token))
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", rows.alias("rows"))


@query(rf"""with {FACTS_SQL},
one as (select doc_id, min(idx) filter (score >= 2 and n >= 3 and idx < 30) as a, min(idx) filter (regexp_matches(text, 'quantity|hsn/sac|hsn code') and idx < 50) as b, min(idx) filter (regexp_matches(text, 'description of goods|item name') and idx < 40) as c,
 min(idx) filter (decimals >= 3 and n >= 3 and idx between 10 and 49) as dd, min(idx) filter (n >= 4 and idx between 8 and 49) as e from facts group by 1),
two as (select o.*, (select min(idx) from facts f where f.doc_id = o.doc_id and idx between b + 1 and b + 9 and numbers >= 2 and n >= 3) as bh, (select n from facts f where f.doc_id = o.doc_id and idx = b) as bn,
 (select min(idx) from facts f where f.doc_id = o.doc_id and idx between c + 1 and c + 7 and n >= 4) as ch from one o),
three as (select *, coalesce(bh, case when bn >= 3 then b end) as bx, coalesce(ch, c) as cx from two)
select doc_id, cast(coalesce(a, bx, cx, dd, e) as int) as header, cast(case when a is not null then a + 1 when bx is not null then b + 1 when cx is not null then c + 1 else coalesce(dd, e) end as int) as start from three""")
def first_header(spark: SparkSession, d: str) -> DataFrame:
    """The row that shows a table's columns, and where its items begin, by all five strategies."""
    return page_rows(spark, d).select("doc_id", T.find_header(F.col("rows")).alias("x")).select("doc_id", "x.header", "x.start")


@query(rf"""with {FACTS_SQL}, stop as (select doc_id, min(idx) filter (regexp_matches(text, '\bmarket\b')) as stop_at, count(*) as n_rows from facts group by 1) select doc_id, cast(coalesce(stop_at, n_rows) as int) as n_before from stop""")
def take_until(spark: SparkSession, d: str) -> DataFrame:
    return page_rows(spark, d).select("doc_id", F.size(K.take_until(F.col("rows"), r"\bmarket\b")).alias("n_before"))


ITEMS_SQL = "article as description, code as hsn, pieces || ' pcs' as quantity, price as \"unitPrice\", amount as \"taxableValue\""


@query(f"""with {WRITTEN_SQL} select upload_id as doc_id, cast(row_number() over (partition by upload_id order by line_id) - 1 as int) as pos, {ITEMS_SQL} from written""")
def description_buffering(spark: SparkSession, d: str) -> DataFrame:
    """Written tables read back: header, columns, descriptions on rows of their own, the end at the total."""
    t = rendered_tables(spark, d).select("doc_id", T.parse_table(F.col("rows"), T.find_header(F.col("rows"))).alias("items"))
    return t.select("doc_id", F.posexplode("items").alias("pos", "x")).select("doc_id", "pos", "x.*")


@query(f"""with {WRITTEN_SQL} select upload_id as doc_id, cast(row_number() over (partition by upload_id order by line_id) - 1 as int) as pos, {ITEMS_SQL} from written""")
def multi_line_merge(spark: SparkSession, d: str) -> DataFrame:
    """Items over three lines of text each."""
    money = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    lines = F.array(F.col("article"), F.col("code"), F.concat_ws(" ", F.concat("pieces", F.lit(" pcs")), money("price"), money("amount")))
    docs = rendered_lines(spark, d).select("upload_id", F.struct("line_id", lines.alias("lines")).alias("l")).groupBy("upload_id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    items = T.merge_lines(F.concat(F.flatten(F.transform("l", lambda x: x["lines"])), F.array(F.lit("Total 12.00"), F.lit("ghost 1 pcs 5.00 5.00"))))
    return docs.select(F.col("upload_id").alias("doc_id"), F.posexplode(items).alias("pos", "x")).select("doc_id", "pos", "x.*")


@query(f"""with {WRITTEN_SQL} select upload_id as doc_id, cast(row_number() over (partition by upload_id order by line_id) - 1 as int) as pos, {ITEMS_SQL} from written where upload_id in (select upload_id from written group by 1 having count(*) > 1)""")
def transposed_items(spark: SparkSession, d: str) -> DataFrame:
    """Invoices of two or more lines written with their fields as rows, read back; one line is no table of that kind."""
    money = lambda c: F.format_string("%.2f", F.col(c).cast("double")).alias(c)
    lines = rendered_lines(spark, d).groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("line_id", "article", "code", F.concat("pieces", F.lit(" pcs")).alias("pieces"), money("price"), money("amount")))).alias("l")).where("size(l) > 1")
    token = lambda text, i: F.struct(text.alias("text"), F.lit(1.0).alias("conf"), F.lit(0).alias("page"), (i * 120.0).alias("cx"), F.lit(0.0).alias("cy"), (i * 120.0).alias("left"), i.alias("idx"))
    row = lambda label, field: F.transform(F.concat(F.array(F.lit(label)), F.transform("l", lambda x: x[field])), token)
    rows = F.array(row("Item name", "article"), row("HSN", "code"), row("Quantity", "pieces"), row("Rate", "price"), row("Amount", "amount"), F.transform(F.array(F.lit("Total 12.00")), token))
    docs = lines.select(F.col("upload_id").alias("doc_id"), rows.alias("rows"))
    items = F.when(T.is_transposed(F.col("rows")), T.parse_transposed(F.col("rows")))
    return docs.select("doc_id", F.posexplode(items).alias("pos", "x")).select("doc_id", "pos", "x.*")


@query(f"""with {TOK_SQL}, n as (select doc_id, idx, row_number() over (partition by doc_id order by idx) as up, count(*) over (partition by doc_id) as n_rows from tok)
select doc_id, 'top' as block, idx, 'p0_r' || up as row_id from n where up <= 5 union all select doc_id, 'mid', idx, 'p0_r' || up from n where up between 6 and 25 union all select doc_id, 'bottom', idx, 'p0_r' || up from n where up > n_rows - 14""")
def positional_blocks(spark: SparkSession, d: str) -> DataFrame:
    """First, second and last rows of every page; a short page's rows are in several."""
    pages = page_documents(spark, d).select("doc_id", F.filter(F.transform("fullText", lambda t, i: F.struct(i.alias("idx"), F.lit(0).alias("page"), t["bbox"].alias("bbox"))), lambda t: t["bbox"].isNotNull()).alias("t"))
    numbered = F.transform("t", lambda t, i: F.array(F.struct(t["idx"].alias("idx"), t["page"].alias("page"), F.concat(F.lit("p0_r"), (i + 1).cast("string")).alias("row_id"))))
    blocks = pages.select("doc_id", K.blocks(numbered).alias("b"))
    named = F.explode(F.map_from_arrays(F.array(*map(F.lit, ("top", "mid", "bottom"))), F.array("b.top", "b.mid", "b.bottom"))).alias("block", "rows")
    return blocks.select("doc_id", named).select("doc_id", "block", F.explode("rows").alias("r")).select("doc_id", "block", F.col("r")[0]["idx"].alias("idx"), F.col("r")[0]["row_id"].alias("row_id"))


@query(f"""with {TOK_SQL}, p as (select doc_id, max(y1) as height from documents, lateral (select unnest(line_boxes).y1 as y1) group by 1) select doc_id, idx from tok join p using (doc_id) where cy > 0.3 * height""")
def below_header(spark: SparkSession, d: str) -> DataFrame:
    """Tokens below the upper three tenths of their page."""
    t = page_documents(spark, d).select("doc_id", F.transform(F.filter(F.transform("fullText", lambda t, i: F.struct(i.alias("idx"), t["bbox"].alias("bbox"))), lambda t: t["bbox"].isNotNull()), lambda t: F.struct(t["idx"].alias("idx"), S.center(t["bbox"])["cy"].alias("cy"), S.extent(t["bbox"])["bottom"].alias("bottom"))).alias("t"))
    return t.select("doc_id", F.explode(K.below_header(F.col("t"), F.array_max(F.transform("t", lambda x: x["bottom"])))).alias("x")).select("doc_id", "x.idx")


@query(f"""with {TOK_SQL}, v as (select doc_id, lang as value from documents where lang is not null), h as (select v.doc_id, v.value, t.idx, t.text, t.conf, row_number() over (partition by v.doc_id order by t.idx) as rn from v join tok t on v.doc_id = t.doc_id and contains(t.text, v.value))
select v.doc_id, v.value, h.idx, h.text, h.conf from v left join h on v.doc_id = h.doc_id and h.rn = 1""")
def value_source_token(spark: SparkSession, d: str) -> DataFrame:
    values = read_table(spark, d, "documents").where("lang is not null").select("doc_id", F.col("lang").alias("value"))
    return K.source_token(values, page_tokens(spark, d))


@query(f"""with {TOK_SQL} select a.doc_id, a.idx as idx_a, b.idx as idx_b from tok a join tok b on a.doc_id = b.doc_id and a.idx < b.idx and (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) < 1600""")
def proximity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return K.near_pairs(page_tokens(spark, d), 40.0).select("doc_id", "idx_a", "idx_b")


@query(f"""select upload_id, cast(sum(cast(round((0.0 + coalesce(a, 0.5) + coalesce(case when isnan(b) then null else b end, 0.5) + coalesce(c, 0.5) + 0.5) * 1000) as bigint)) as double) / (4000 * count(*)) as avg_confidence from (
select l.upload_id, u.ocr_confidence as a, l.qty_confidence as b, 1 - u.glare as c from {once_sql("line_items", "line_id", "upload_id", "qty_confidence")} l left join {once_sql("uploads", "upload_id", "ocr_confidence", "glare")} u using (upload_id)) group by 1""")
def average_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Mean confidence of four fields a line; of the last nothing is known."""
    li = once(spark, d, "line_items", "line_id", "upload_id", "qty_confidence").join(once(spark, d, "uploads", "upload_id", "ocr_confidence", "glare"), "upload_id", "left")
    li = li.select("upload_id", F.col("ocr_confidence").alias("description"), F.col("qty_confidence").alias("qty"), (1 - F.col("glare")).alias("unitPrice"), F.lit(None).cast("double").alias("gstRate"))
    return A.average_confidence(li, "upload_id", ["description", "qty", "unitPrice", "gstRate"])


@query(f"""with {RENDERED_SQL} select upload_id, case when invoice_no is not null or true then 'Tax Invoice' end as "documentType", upload_id % 2 = 0 as "isComputerGenerated", coalesce('for ' || legal_name, 'M/s ' || legal_name) as "authorisedSignatory" from inv""")
def first_and_last(spark: SparkSession, d: str) -> DataFrame:
    """Kind and signatory of written invoices: first and last texts of their kind."""
    return rendered_invoices(spark, d).select("upload_id", P.document_meta(F.col("texts")).alias("m")).select("upload_id", "m.*")


def _cents(c: str) -> str:
    return f"cast(abs({c}) as decimal(18,2))"


@query(f"""with {RENDERED_SQL} select upload_id, {_cents("net_total")} as "subTotal", {_cents("cgst")} as cgst, {_cents("sgst")} as sgst, {_cents("igst")} as igst, {_cents("gross_total")} as "totalAmount",
case when cgst is not null or sgst is not null then cast(coalesce({_cents("cgst")}, 0) + coalesce({_cents("sgst")}, 0) as decimal(18,2)) else {_cents("igst")} end as "totalTax", cast(round_off_delta as decimal(18,2)) as "roundOff", cast(page_count as varchar) as "totalQty", 'Ten Rupees only' as "totalInWords" from inv""")
def totals_regex(spark: SparkSession, d: str) -> DataFrame:
    """Totals of written invoices, read back."""
    t = rendered_invoices(spark, d).select("upload_id", P.totals(F.concat_ws("\n", "texts")).alias("t"))
    return t.select("upload_id", *(f"t.{c}" for c in ("subTotal", "cgst", "sgst", "igst", "totalAmount", "totalTax", "roundOff", "totalQty", "totalInWords")))


@query(rf"""with {RENDERED_SQL} select upload_id, invoice_no as number, case when regexp_full_match(invoice_date_raw, '\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{1,2}}-[A-Za-z]{{3}}-\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}') then invoice_date_raw end as "dateRaw",
place_of_supply as "placeOfSupply", 'R/' || upload_id as "referenceNo", '2024-06-05' as "referenceDate", '17' || upload_id as "ackNo", translate(substr(sha256(cast(upload_id as varchar)), 1, 20), '6789', 'abcd') as irn from inv""")
def header_regex(spark: SparkSession, d: str) -> DataFrame:
    """Header fields of written invoices, read back."""
    h = rendered_invoices(spark, d).select("upload_id", P.header(F.concat_ws("\n", "texts")).alias("h"))
    return h.select("upload_id", *(f"h.{c}" for c in ("number", "dateRaw", "placeOfSupply", "referenceNo", "referenceDate", "ackNo", "irn")))


@query(f"""with {RENDERED_SQL} select upload_id, legal_name as seller, gstin as seller_gstin, case when gstin is not null then 'Neelgarh' end as state, substr(gstin, 1, 2) as state_code, 'Buyer ' || upload_id as buyer,
'+91' || (9000000000 + upload_id % 1000000) as phone, '+91' || (9000000000 + upload_id % 1000000) as contact from inv""")
def parties_regex(spark: SparkSession, d: str) -> DataFrame:
    """Sellers and buyers of written invoices, read back."""
    text = F.concat_ws("\n", "texts")
    p = rendered_invoices(spark, d).select("upload_id", P.seller(text).alias("s"), P.buyer(text).alias("b"))
    return p.select("upload_id", F.col("s.name").alias("seller"), F.col("s.gstin").alias("seller_gstin"), F.col("s.state").alias("state"), F.col("s.stateCode").alias("state_code"), F.col("b.name").alias("buyer"), "b.phone", "b.contact")


@query(f"""with {RENDERED_SQL} select upload_id, legal_name as seller, gstin as seller_gstin, 'Neelgarh Godown' as address, 0.8 as seller_confidence, 'Buyer ' || upload_id as buyer, case when gstin is not null then '99AAAAA0000A1Z5' end as buyer_gstin,
invoice_no as number, case when invoice_no is not null then 0.95 else 0.0 end as number_confidence from inv where legal_name is not null""")
def header_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Parties of pages whose seller stands at the upper left and buyer at the lower right: clusters of tokens, then the first text of each."""
    box = lambda x, y: F.array(*(F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ((x, y), (x + 90, y), (x + 90, y + 20), (x, y + 20))))
    token = lambda text, x, y, conf: F.struct(text.alias("text"), box(x, y).alias("bbox"), F.lit(conf).cast("double").alias("conf"))
    i = once(spark, d, "invoices", "upload_id", "invoice_no").join(once(spark, d, "uploads", "upload_id", "vendor_id"), "upload_id").join(read_table(spark, d, "vendors").select("vendor_id", "vendor_gstin", "legal_name"), "vendor_id")
    number = F.when(F.col("invoice_no").isNotNull(), F.concat(F.lit("Invoice No. "), F.col("invoice_no")))
    tokens = F.array(
        token(F.col("legal_name"), 50, 50, 0.9), token(F.concat(F.lit("GSTIN "), F.col("vendor_gstin")), 50, 80, 0.9), token(F.lit("Neelgarh Godown"), 50, 110, 0.9), token(F.lit("Buyer"), 900, 950, 0.9),
        token(F.concat(F.lit("Buyer "), F.col("upload_id").cast("string")), 900, 900, 0.9), token(F.lit("99AAAAA0000A1Z5"), 900, 980, 0.9), token(number, 1800, 50, 0.95),
    )
    # The label "Buyer" is read behind the name below which it stands.
    ordered = F.array_sort(F.transform(F.filter(tokens, lambda t: t["text"].isNotNull()), lambda t: F.struct(t["bbox"][0][0].alias("x"), t["bbox"][0][1].alias("y"), t.alias("t"))))
    p = i.select("upload_id", F.transform(ordered, lambda x: x["t"]).alias("t"))
    labels = cluster_labels(F.transform("t", lambda t: S.center(t["bbox"])["cx"]), F.transform("t", lambda t: S.center(t["bbox"])["cy"]))
    h = p.select("upload_id", "t", labels.alias("labels")).select("upload_id", P.header_blocks(F.col("t"), F.col("labels")).alias("h"))
    return h.select(
        "upload_id", F.col("h.seller.name").alias("seller"), F.col("h.seller.gstin").alias("seller_gstin"), "h.seller.address", F.col("h.seller.confidence").alias("seller_confidence"), F.col("h.buyer.name").alias("buyer"), F.col("h.buyer.gstin").alias("buyer_gstin"),
        F.col("h.invoice.number.value").alias("number"), F.col("h.invoice.number.confidence").alias("number_confidence"),
    )


@query(f"""with {WRITTEN_SQL} select line_id, cast(1 as int) as "slNo", case when line_id % 2 = 1 then article when length(article) between 4 and 29 then upper(article) else upper(substr(article, 1, 4)) end as description, cast(pieces as int) || ' KG' as quantity, price as rate, 'KG' as per, cast(cast(pieces as decimal(18,2)) * price as decimal(18,2)) as "taxableValue",
code as hsn, cast(9 as decimal(9,2)) as "cgstRate", cast(9 as decimal(9,2)) as "sgstRate" from written""")
def item_views(spark: SparkSession, d: str) -> DataFrame:
    """Items as other systems expect them; a page's text in capitals that holds the description is the better one."""
    li = rendered_lines(spark, d)
    texts = F.array(F.lit("lower case"), F.when(F.col("line_id") % 2 == 0, F.upper("article")).otherwise(F.lit("Zz")))
    line = F.struct(
        F.when(F.col("line_id") % 2 == 0, F.upper(F.substring("article", 1, 4))).otherwise(F.col("article")).alias("description"), F.col("code").alias("hsn"), F.col("pieces").cast("double").alias("qty"), F.lit("kg").alias("unit"),
        F.col("price").cast("double").alias("unitPrice"), F.lit(0.18).alias("gstRate"),
    )
    return li.select("line_id", F.get(A.item_view(F.array(line), texts), F.lit(0)).alias("x")).select("line_id", "x.*")


ENTRY = ("net_total", "cgst", "sgst", "igst", "gross_total")
ENTRIES_SQL = f"""select upload_id, account, cast(coalesce(debit, 0) as decimal(18,2)) as debit, cast(coalesce(credit, 0) as decimal(18,2)) as credit from (
 select upload_id, 'Purchases' as account, net_total as debit, 0.0 as credit from i union all select upload_id, 'Input CGST', cgst, 0 from i union all select upload_id, 'Input SGST', sgst, 0 from i
 union all select upload_id, 'Input IGST', igst, 0 from i union all select upload_id, 'Creditors', 0, gross_total from i)"""


@query(f"with i as {once_sql('invoices', 'upload_id', *ENTRY)} select * from ({ENTRIES_SQL}) where debit <> 0 or credit <> 0")
def accounting_entries(spark: SparkSession, d: str) -> DataFrame:
    return A.accounting_entries(once(spark, d, "invoices", "upload_id", *ENTRY).na.fill(0.0), "upload_id", "net_total", "cgst", "sgst", "igst", "gross_total")


@query(f"select place_of_supply, count(*) as n_invoices, cast(sum(cast(net_total as decimal(18,2))) as decimal(18,2)) as taxable, cast(sum(cast(tax_total as decimal(18,2))) as decimal(18,2)) as tax from {once_sql('invoices', 'upload_id', 'place_of_supply', 'net_total', 'tax_total')} group by 1")
def tax_return(spark: SparkSession, d: str) -> DataFrame:
    money = lambda c: F.sum(F.col(c).cast(MONEY)).cast(MONEY)
    return once(spark, d, "invoices", "upload_id", "place_of_supply", "net_total", "tax_total").groupBy("place_of_supply").agg(F.count("*").alias("n_invoices"), money("net_total").alias("taxable"), money("tax_total").alias("tax"))


@query(f"select upload_id as document_id, invoice_no as reference, cast(gross_total as decimal(18,2)) as payable, coalesce(place_of_supply, '') as region from {once_sql('invoices', 'upload_id', 'invoice_no', 'gross_total', 'place_of_supply')}")
def erp_projection(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "invoices", "upload_id", "invoice_no", "gross_total", "place_of_supply").select(
        F.col("upload_id").alias("document_id"), F.col("invoice_no").alias("reference"), F.col("gross_total").cast(MONEY).alias("payable"), F.coalesce("place_of_supply", F.lit("")).alias("region")
    )


@query()
def engine_info(spark: SparkSession, d: str) -> DataFrame:
    return A.engine_info(spark)


@query(f"""with {SUMS_SQL} select l_orderkey, gross from sums order by gross desc, l_orderkey limit 100""")
def topk_orders(spark: SparkSession, d: str) -> DataFrame:
    return R.summarize(invoice_lines(spark, d), "l_orderkey").select("l_orderkey", "gross").orderBy(F.desc("gross"), "l_orderkey").limit(100)


@query(f"select upload_id, 'invoice' as kind from {once_sql('invoices', 'upload_id')} union all select upload_id, 'line' from {once_sql('line_items', 'line_id', 'upload_id')} union all select upload_id, 'entity' from {once_sql('entities', 'entity_id', 'upload_id')}")
def union_records(spark: SparkSession, d: str) -> DataFrame:
    part = lambda kind, *k: once(spark, d, *k).select("upload_id", F.lit(kind).alias("kind"))
    return part("invoice", "invoices", "upload_id").unionByName(part("line", "line_items", "line_id", "upload_id")).unionByName(part("entity", "entities", "entity_id", "upload_id"))


@query("select u.upload_id from (select distinct upload_id from uploads) u where not exists (select 1 from invoices i where i.upload_id = u.upload_id)")
def uploads_without_invoice(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "uploads").select("upload_id").distinct().join(read_table(spark, d, "invoices").select("upload_id"), "upload_id", "left_anti")


@query("select vendor_id, count(distinct branch_code) as branches, count(distinct upload_id) as uploads from uploads group by 1")
def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "uploads").groupBy("vendor_id").agg(F.count_distinct("branch_code").alias("branches"), F.count_distinct("upload_id").alias("uploads"))


@query(f"with {TOK_SQL} select doc_id, idx, x0, y0, x1, y1, printf('%s (%.3f)', text, conf) as label from tok")
def overlay(spark: SparkSession, d: str) -> DataFrame:
    return A.overlay(page_tokens(spark, d), places=3)


def _personal(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """What all texts of the written invoices and of the pages hold."""
    written = rendered_invoices(spark, d).select(F.lit("invoice").alias("kind"), F.col("upload_id").alias("id"), F.concat_ws("\n", "texts").alias("text"))
    pages = read_table(spark, d, "documents").select(F.lit("page").alias("kind"), F.col("doc_id").alias("id"), "text")
    return written.unionByName(pages).select("kind", "id", F.explode(S.personal(kind, F.col("text"))).alias("found"))


def _personal_sql(kind: str, written: str) -> str:
    return f"with {RENDERED_SQL} select 'invoice' as kind, upload_id as id, {written} as found from inv where {written} is not null union all select 'page', doc_id, unnest(regexp_extract_all(text, '{S.PERSONAL[kind]}')) from documents"


@query(_personal_sql("email", "'desk' || upload_id || '@example.in'"))
def personal_email(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, "email")


@query(_personal_sql("pan", "substr(gstin, 3, 10)"))
def personal_pan(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, "pan")


@query(_personal_sql("phone", "'+91' || (9000000000 + upload_id % 1000000)"))
def personal_phone(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, "phone")


@query(f"""select upload_id, cast(sum(coalesce(cast(net_amount as decimal(18,2)), 0)) as decimal(18,2)) as total_amount,
case when sum(coalesce(n, 0)) > 0 then sum(coalesce(n, 0)) || ' PCS' end as total_qty from (select *, try_cast(nullif(regexp_extract(qty_value, '([0-9]+)', 1), '') as int) as n from {once_sql("line_items", "line_id", "upload_id", "net_amount", "qty_value")}) group by 1""")
def recompute_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.line_sums(once(spark, d, "line_items", "line_id", "upload_id", "net_amount", "qty_value"), "upload_id", F.col("net_amount"), F.col("qty_value"))


def rebuilt_responses(responses: DataFrame) -> DataFrame:
    """Stored responses rebuilt from their tokens, with the quality and hashes that they record."""
    docs = stored_documents(responses, meta=True)
    t = docs.select("doc_id", "meta", K.rows_by_median(K.geometry_tokens(F.col("fullText"))).alias("rows"))
    t = t.select("*", H.column_centers_of(F.col("rows")).alias("centers"))
    t = t.select("doc_id", "meta", K.stitch(F.col("rows")).alias("p"), H.lines_from_rows(F.col("rows"), F.col("centers")).alias("lines"))
    return H.build_responses(t.select(
        "doc_id", F.col("p.head").alias("text"), F.col("p.tail").alias("tail"), "lines", F.col("meta.quality.focus").alias("focus"), F.col("meta.quality.glare").alias("glare"), F.col("meta.ocrConfidence").alias("ocr_confidence"),
        F.col("meta.uploadHash").alias("upload_hash"), F.col("meta.phash").alias("phash"),
    ))


@query()
def rich_responses(spark: SparkSession, d: str) -> DataFrame:
    """Stored responses rebuilt from their tokens: rows, columns by exact centres, lines, totals and warnings."""
    whole = rebuilt_responses(read_table(spark, d, "ocr_responses"))
    return whole.select("doc_id", F.size("lines").alias("n_lines"), "totals.*", F.size("warnings").alias("n_warnings"))


@query(f"""with {WRITTEN_SQL} select line_id, {ITEMS_SQL} from written""")
def parse_item_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines written out as text and read back."""
    money = lambda c: F.concat(F.lit("₹ "), F.format_string("%,.2f", F.col(c).cast("double")))
    text = F.concat_ws(" ", F.lit("1"), "article", "code", F.concat("pieces", F.lit("pcs")), money("price"), money("amount"), F.lit("(5.0%)"))
    return rendered_lines(spark, d).select("line_id", T.parse_item_line(text).alias("x")).where("x is not null").select("line_id", "x.*")


@query()
def extract_tables(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the stored responses' tables, from tokens below the header band."""
    return H.extract_tables(stored_documents(read_table(spark, d, "ocr_responses")).withColumn("height", F.lit(None).cast("double")), band=0.0)


@query()
def extract_structured(spark: SparkSession, d: str) -> DataFrame:
    """Stored responses to structured invoices, from their tokens."""
    out = extract_invoices(stored_documents(read_table(spark, d, "ocr_responses")))
    return out.select("doc_id", "tier", "invoice.number", "invoice.date", F.col("seller.name").alias("seller"), F.col("buyer.name").alias("buyer"), F.size("items").alias("n_items"), "totals.totalAmount", "totals.subTotal")


@query()
def extracted_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of the structured invoices."""
    return explode_items(extract_invoices(stored_documents(read_table(spark, d, "ocr_responses"))))


@query()
def cluster_dbscan(spark: SparkSession, d: str) -> DataFrame:
    return cluster_tokens(page_tokens(spark, d))


@query()
def kmeans_columns(spark: SparkSession, d: str) -> DataFrame:
    return column_centers(page_tokens(spark, d))


@query(f"""with {LINES_SQL}, l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, net, tax, gross) as rn from lines),
g as (select l_orderkey, string_agg('r' || rn || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || net || ':' || tax || ':' || gross, ',' order by rn) as lines from l group by 1)
select o_orderkey as l_orderkey, o_custkey, o_totalprice, coalesce(lines, '') as lines from orders left join g on o_orderkey = l_orderkey""")
def assembled_invoices(spark: SparkSession, d: str) -> DataFrame:
    """Orders as nested documents, their lines in order."""
    heads = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice")
    doc = A.assemble(heads, invoice_lines(spark, d), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])
    parts = ("rowId", "l_linenumber", "l_partkey", "l_suppkey", "net", "tax", "gross")
    return doc.select("l_orderkey", "o_custkey", "o_totalprice", F.concat_ws(",", F.transform("lines", lambda x: F.concat_ws(":", *(x[p].cast("string") for p in parts)))).alias("lines"))
