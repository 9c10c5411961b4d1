"""Tokens, tables, amounts, images, clusters, sources and streams on small fixtures."""

import json
import statistics
from decimal import Decimal as D

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.functions import scalars as S
from foliospark.operators import assemble as A
from foliospark.operators import quality as Q
from foliospark.operators import reconcile as R
from foliospark.operators import rich as H
from foliospark.operators import table as T
from foliospark.operators import tokens as K
from foliospark.operators.clusters import best_centers, density_labels
from foliospark.plans import reference
from foliospark.schemas import OCR_DOCUMENT, RESPONSE
from foliospark.sources.readers import apply_adapter, documents_of, read_documents, read_images, read_uploads, stored_documents
from foliospark.streaming.dedup import first_deliveries, windowed


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def lit_rows(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def test_scalars(spark):
    df = lit_rows(spark, ["₹ 39,187.00", "1,00,000.5", "x", "", None, "-12", "5.0%", "Sub Total ₹ 39,187.00 x 12.5"])
    got = [tuple(r) for r in df.orderBy("i").select(S.amount(F.col("v")), S.amount_in_text(F.col("v"))).collect()]
    assert [g[0] for g in got][:6] == [D("39187.00"), D("100000.50"), None, None, None, D("-12.00")]
    assert got[0][1] == D("39187.00") and got[6][1] is None and got[7][1] == D("39187.00")
    dates = lit_rows(spark, ["20-08-2025", "1/2/69", "1/2/68", "31-02-2020", "soon", None]).orderBy("i").select(S.iso_date(F.col("v")).alias("d")).collect()
    assert [r["d"] for r in dates] == ["2025-08-20", "1969-02-01", "2068-02-01", "31-02-2020", "soon", None]
    units = lit_rows(spark, ["149 Bag", "50PCS", "3 ml", "12", None]).orderBy("i").select(S.quantity_unit(F.col("v")).alias("u")).collect()
    assert [r["u"] for r in units] == ["bag", "pcs", "ml", None, None]
    r = one(spark, d=S.clean_description(F.lit("Paper A4  HSN/SAC This is")), g=S.valid_gstin(F.lit("10CKXPK7984A1ZV")), n=S.valid_gstin(F.lit(None)), c=S.confidence(F.lit(0.0), F.lit(None).cast("double")), s=S.split_rate(F.lit(None).cast("double")))
    assert (r["d"], r["g"], r["n"], r["c"], tuple(r["s"])) == ("Paper A4", True, False, 1.0, (9.0, 9.0))
    box = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((1, 2), (5, 2), (5, 8), (1, 8))))
    r = one(spark, c=S.center(box), a=S.area(box), h=S.hull(F.array(box, box)), e=S.center(F.array().cast("array<array<double>>")))
    assert tuple(r["c"]) == (3.0, 5.0) and r["a"] == 24.0 and r["h"][2] == [5.0, 8.0] and r["e"]["cx"] is None


def plain_rows(cys, tol):
    rows = []
    for y in sorted(cys):
        if rows and abs(y - statistics.median(rows[-1])) <= tol:
            rows[-1].append(y)
        else:
            rows.append([y])
    return rows


def test_rows_keep_tokens_and_follow_the_median(spark):
    rng = np.random.default_rng(3)
    docs = [(i, [(f"t{j}", [[float(x), float(y)]], None, None, None, None) for j, (x, y) in enumerate(zip(rng.integers(0, 500, n), rng.integers(0, 300, n)))]) for i, n in enumerate((0, 1, 2, 30, 120))]
    df = spark.createDataFrame(docs, OCR_DOCUMENT)
    got = {r["doc_id"]: r["rows"] for r in df.select("doc_id", K.rows_by_median(K.geometry_tokens(F.col("fullText")), 16.0).alias("rows")).collect()}
    for i, toks in docs:
        want = plain_rows([t[1][0][1] for t in toks], 16.0)
        assert [sorted(t["cy"] for t in r) for r in got[i]] == want
        assert all([t["left"] for t in r] == sorted(t["left"] for t in r) for r in got[i])
        assert sorted(t["idx"] for r in got[i] for t in r) == list(range(len(toks)))


def test_pages_and_regions(spark):
    t = spark.createDataFrame([(1, i, float(y), 5.0) for i, y in enumerate((100, 1500, 100, 1400, 90))], "doc_id int, idx int, cy double, cx double")
    assert [r["page"] for r in K.page_breaks(t).orderBy("idx").collect()] == [0, 0, 1, 1, 2]
    assert K.in_region(t, 5, 100, 5, 1400).count() == 3 and K.bottom_share(t).count() == 2
    assert K.near_pairs(t, 50.0).count() == 3


def test_columns_cover_every_place(spark):
    lefts = F.array(*(F.lit(float(x)) for x in (100, 200, 300, 310)))
    bounds = one(spark, b=T.column_bounds(lefts))["b"]
    assert len(bounds) == 3 and bounds[0]["l"] < -1e5 and bounds[-1]["r"] > 1e5
    df = spark.range(0, 1000, 7).select(T.column_of(F.col("id").cast("double"), T.column_bounds(lefts)).alias("c"))
    assert {r["c"] for r in df.collect()} == {0, 1, 2}
    gap = F.array(F.struct(F.lit(0.0).alias("l"), F.lit(10.0).alias("r")), F.struct(F.lit(50.0).alias("l"), F.lit(60.0).alias("r")))
    assert one(spark, a=T.column_of(F.lit(20.0), gap), b=T.column_of(F.lit(45.0), gap), c=T.nearest_center(F.lit(3.0), F.array(F.lit(1.0), F.lit(5.0)))).asDict() == {"a": 0, "b": 1, "c": 0}


@pytest.mark.parametrize("text,want", [
    ("1 NATURAL GYPSUM CALCINED PLASTER 2520 149 Bag ₹ 263.00 ₹ 39,187.00 (5.0%)", ("NATURAL GYPSUM CALCINED PLASTER", "2520", "149 Bag", D("263.00"), D("39187.00"))),
    ("Clay brick 12 10.50 126.00", ("Clay brick 12", None, "12", D("10.50"), D("126.00"))), ("no amounts here", None), ("", None), (None, None),
])
def test_item_lines(spark, text, want):
    got = one(spark, x=T.parse_item_line(F.lit(text).cast("string")))["x"]
    assert got == want if want is None else tuple(got) == want


def test_lines_are_used_once(spark):
    lines = F.array(*map(F.lit, ("1 GYPSUM", "2520", "149 Bag 263.00 39,187.00", "Clay brick 5 pcs 2.00 10.00", "Total 12.00", "ghost 1 pcs 5.00 5.00")))
    got = one(spark, x=T.merge_lines(lines))["x"]
    assert [(x["quantity"], x["taxableValue"]) for x in got] == [("149 Bag", D("39187.00")), ("5 pcs", D("10.00"))]


def test_transposed(spark):
    rows = [[(w, 0.9, 0, float(x * 100), float(y * 40), float(x * 100), 0) for x, w in enumerate(r)] for y, r in enumerate((["Quantity", "4", "6"], ["Rate", "10.00", "20.00"], ["Amount", "40.00", "120.00"], ["HSN", "2520", "6904"]))]
    df = spark.createDataFrame([(rows,)], "rows array<array<struct<text: string, conf: double, page: int, cx: double, cy: double, left: double, idx: int>>>")
    r = df.select(T.is_transposed(F.col("rows")).alias("t"), T.parse_transposed(F.col("rows")).alias("x")).first()
    assert r["t"] and [(x["quantity"], x["hsn"], x["taxableValue"]) for x in r["x"]] == [("4", "2520", D("40.00")), ("6", "6904", D("120.00"))]


def test_reconciliation(spark):
    d = lambda v: F.lit(v).cast("decimal(18,2)")
    r = one(spark, a=R.line_amounts(F.lit(40), F.lit(345.0), F.lit(0.18)), s=R.split_tax(F.lit(2484.0), F.lit(None).cast("string")), i=R.split_tax(F.lit(2484.0), F.lit("Delhi")), ok=R.reconciled(d("16284"), d("16284.99")), no=R.reconciled(d("10"), d(None)))
    assert tuple(r["a"]) == (D("13800.00"), D("2484.00"), D("16284.00")) and tuple(r["s"]) == (D("1242.00"), D("1242.00"), D("0.00")) and r["i"]["igst"] == D("2484.00")
    assert tuple(r["ok"]) == (True, D("0.99")) and tuple(r["no"]) == (True, D("0.00"))
    r = one(spark, m=R.mend_price(F.lit(None).cast("double"), F.lit(1000.0), F.lit(10)), s=R.mend_price(F.lit(500.0), F.lit(100.0), F.lit(5)), k=R.mend_price(F.lit(514.0), F.lit(755.0), F.lit(2)), z=R.mend_price(F.lit(0.0), F.lit(5.0), F.lit(0)))
    assert r["m"]["price"] == D("100.00") and tuple(r["s"]) == (D("100.00"), D("500.00")) and r["k"]["price"] == D("514.00") and r["z"]["price"] == D("0.00")
    # Without a quantity nothing is swapped, and what is consistent stays.
    r = one(spark, n=R.mend_price(F.lit(500.0), F.lit(100.0), F.lit(None).cast("int")), c=R.mend_price(F.lit(400.0), F.lit(100.0), F.lit(0)), e=R.mend_price(F.lit(100.0), F.lit(102.0), F.lit(1)))
    assert [tuple(x) for x in r] == [(D("500.00"), D("100.00")), (D("400.00"), D("100.00")), (D("100.00"), D("102.00"))]
    assert one(spark, w=R.special_line(F.lit("Freight charges")))["w"] == "freight"


def picture(g):
    return bytearray(np.repeat(g.astype(np.uint8)[..., None], 3, 2).tobytes())


def test_image_metrics(spark):
    flat, rng = np.full((60, 80), 128), np.random.default_rng(1)
    bar = np.full((200, 200), 255)
    for i in range(150):
        bar[40 + i // 5 : 60 + i // 5, 20 + i] = 0
    noisy = rng.integers(0, 200, (60, 80))
    rows = [(k, bytes(picture(g)), g.shape[0], g.shape[1], 3) for k, g in (("flat", flat), ("bar", bar), ("noisy", noisy))] + [("bad", b"123", 5, 5, 3), ("none", None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, data binary, height int, width int, nChannels int").select("name", F.struct("data", "height", "width", "nChannels").alias("image"))
    got = {r["name"]: r for r in Q.measure_images(df).collect()}
    assert got["flat"]["focus"] == 0 and got["noisy"]["focus"] > 1000 and got["flat"]["glare"] == 0 and got["bar"]["glare"] > 0.5
    assert abs(abs(got["bar"]["skew_deg"]) - 11.3) < 1.5 and got["bad"]["focus"] is None and got["none"]["phash"] is None and len(got["bar"]["phash"]) == 16
    near = noisy.copy()
    near[0, 0] += 3
    assert bin(int(Q.perceptual_hash(noisy.astype(float)), 16) ^ int(Q.perceptual_hash(near.astype(float)), 16)).count("1") <= 4


def test_gate_and_warnings(spark):
    g = lambda m, f, gl, e: Q.gate(F.lit(m), F.lit(f), F.lit(gl), F.lit(e), F.lit(100))
    r = one(spark, a=g("image/png", 100.0, 0.01, 1600), b=g("image/png", 10.0, 0.01, 1600), c=g("application/pdf", 10.0, 0.01, 1600), d=g("image/png", None, 0.01, 1600))
    assert [tuple(x) for x in r] == [(True, False), (False, True), (False, False), (False, True)]
    w = one(spark, w=Q.warnings(F.lit(10.0), F.lit(0.2), F.lit(0.1)), l=Q.line_warnings(F.array(F.struct(F.lit(0.5).alias("qty_conf"), F.lit(0.9).alias("price_conf")))))
    assert [x["code"] for x in w["w"]] == ["LOW_FOCUS", "HIGH_GLARE", "LOW_CONF_FIELD"] and w["l"][0]["field"] == "lines[0].qty"
    r = one(spark, s=Q.handwriting_score(F.lit(0.2), F.lit(3.0), F.lit(0.1)), b=Q.better_reading(F.lit("a"), F.lit(0.4), F.lit("b"), F.lit(0.75), F.lit(0.7)))
    assert abs(r["s"] - 0.7) < 1e-9 and tuple(r["b"]) == ("b", 0.75, True)


def test_clusters_against_brute_force():
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 2000, 80), rng.uniform(0, 2000, 80)
    got = density_labels(x, y, 200)
    seen, want, nxt = {}, [-1] * 80, 0
    for i in range(80):
        if i in seen:
            continue
        todo, part = [i], {i}
        while todo:
            a = todo.pop()
            for b in range(80):
                if b not in part and (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2 <= 200**2:
                    part.add(b)
                    todo.append(b)
        seen.update(dict.fromkeys(part))
        if len(part) > 1:
            for j in part:
                want[j] = nxt
            nxt += 1
    assert got.tolist() == want
    assert best_centers(np.array([1.0, 2, 10, 11, 50]), 3).tolist() == [1.5, 10.5, 50.0] and best_centers(np.array([4.0, 4.0]), 5).tolist() == [4.0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"not a picture")
    (tmp_path / "b.txt").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in read_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.png": "ok", "b.txt": "unsupported"}
    assert read_images(spark, str(tmp_path)).count() == 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_text('{"doc_id": 7, "fullText": [{"text": "a", "bbox": [[0, 0]], "conf": 0.5}]}')
    assert read_documents(spark, str(tmp_path / "d")).first()["fullText"][0]["text"] == "a"
    stored = spark.createDataFrame([(1, '{"fullText":[{"text":"a","bbox":[1,2,3,4]},null,{}]}'), (1, '{"fullText":[{"text":"a","bbox":[1,2,3,4]},null,{}]}'), (2, "bad"), (None, "{}")], "response_id bigint, payload string")
    docs = stored_documents(stored).collect()
    assert len(docs) == 1 and docs[0]["fullText"][0]["bbox"][2] == [3.0, 4.0]

    def load():
        return lambda pdf: pd.DataFrame({"doc_id": pdf["id"], "page": 0, "idx": 0, "text": "hi", "bbox": [[[0.0, 0.0]]] * len(pdf), "conf": 0.5, "confidence": None, "handwritten": None, "hw_score": None})

    assert documents_of(apply_adapter(spark.range(3), load)).count() == 3


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "upload_id bigint, t string").select("upload_id", F.to_timestamp("t").alias("ingested_at"), F.lit("k").alias("k"), F.lit(1.0).alias("v"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = first_deliveries(stream).writeStream.format("memory").queryName("first").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("first").count() == 2
    q = windowed(stream, "ingested_at", "k", "v").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("win").count() == 3


def test_assembly(spark):
    heads = spark.createDataFrame([(1, "a"), (2, "b")], "k int, h string")
    lines = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "k int, o int, v string")
    got = {r["k"]: [(x["rowId"], x["v"]) for x in r["lines"]] for r in A.assemble(heads, lines, "k", ["o"]).collect()}
    assert got == {1: [("r1", "x"), ("r2", "y")], 2: []}
    acc = A.extraction_accuracy(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k").collect()
    assert {r["k"]: float(r["accuracy"]) for r in acc} == {1: 50.0, 2: 0.0}


def test_config_and_schemas(spark, monkeypatch):
    monkeypatch.setenv("MAX_PAGES", "5")
    monkeypatch.setenv("REJECT_IF_BAD_QUALITY", "false")
    c = Config.from_env()
    assert c.max_pages == 5 and c.reject_if_bad_quality is False and c.min_focus == 80.0
    assert spark.createDataFrame([], RESPONSE).count() == 0


def test_cells_and_rich_lines(spark):
    cells = [(1, [0, 0, 50, 9], "Description", 0.9), (1, [60, 0, 90, 9], "Qty", 0.9), (1, [0, 20, 50, 29], "Clay brick", 0.8), (1, [60, 21, 90, 29], "6904", 0.9), (1, [100, 20, 120, 29], "40 pcs", None), (1, [130, 20, 150, 29], "345.00", 0.7), (1, [160, 20, 180, 29], "18%", 0.9), (1, [0, 40, 9, 49], "ghost", 0.9), (2, None, "x", 0.1)]
    df = spark.createDataFrame(cells, "doc_id bigint, bbox array<int>, text string, conf double")
    r = H.lines_from_cells(df).collect()
    assert [(x["description"], x["hsn"], x["qty"], x["unit"], x["unitPrice"], x["gstRate"]) for x in r] == [("Clay brick", "6904", 40.0, "pcs", 345.0, 0.18)]
    rows = [[("Clay brick", 0.8, 0, 10.0, 5.0, 0.0, 0), ("6904", 0.9, 0, 100.0, 5.0, 90.0, 1), ("40 pcs", 0.5, 0, 200.0, 5.0, 190.0, 2), ("345.00", 0.9, 0, 300.0, 5.0, 290.0, 3), ("18", 0.9, 0, 400.0, 5.0, 390.0, 4)], [("Total", 0.9, 0, 10.0, 50.0, 0.0, 5)]]
    kind = "rows array<array<struct<text: string, conf: double, page: int, cx: double, cy: double, left: double, idx: int>>>"
    d = spark.createDataFrame([(rows,)], kind).select(F.lit(1).alias("doc_id"), F.lit("Invoice No.: 7\nCGST@9% 1242.00\nSGST@9% 1242.00\nTotal: 16,284.00").alias("text"), H.lines_from_rows(F.col("rows"), F.array(*map(F.lit, (10.0, 100.0, 200.0, 300.0, 400.0)))).alias("lines"), F.lit(20.0).alias("focus"), F.lit(0.0).alias("glare"), F.lit(0.9).alias("ocr_confidence"), F.lit("").alias("upload_hash"), F.lit("").alias("phash"))
    r = H.build_responses(d).first()
    line = r["lines"][0]
    assert (line["lines"]["description"], line["lines"]["hsn"], line["computed"]["gross"]) == ("Clay brick", "6904", D("16284.00"))
    t = r["totals"]
    assert (t["net"], t["tax"], t["gross"], t["cgst"], t["igst"], t["reconciled"]) == (D("13800.00"), D("2484.00"), D("16284.00"), D("1242.00"), None, True)
    assert [w["code"] for w in r["warnings"]] == ["LOW_FOCUS", "LOW_CONF_FIELD"] and r["invoice"]["number"] == "7"


def test_rebuilt_responses_match_brute_force(spark, tmp_path):
    lefts, fields = [100, 420, 500, 600, 720], ["description", "hsn", "qty", "unitPrice", "gstRate"]
    # The first row has no code, so its four centres aren't the columns'.
    table = [("Clay brick No.1", None, "66 pcs", "810.93", "18"), ("Wheat flour coarse grade", "1101", "631 kg", "347.07", "5"), ("Twine", "5607", "3 pcs", "93.90", "12"), ("Steel wire rope", None, "16 m", "158.48", "18")]

    def document(meta, rows):
        tokens, y = [{"text": "Invoice No.: 8857", "bbox": [103, 50, 249, 70], "conf": 0.9}], 100
        for r in rows:
            tokens += [{"text": t, "bbox": [x, y, x + 10 * len(t), y + 20], "conf": 0.9} for x, t in zip(lefts, r) if t]
            y += 40
        return json.dumps({"meta": meta, "fullText": tokens})

    quality = lambda f, g: {"ocrConfidence": 0.8, "quality": {"focus": f, "glare": g}, "uploadHash": "ab", "phash": "cd"}
    given = {1: (quality(50.0, 0.01), table), 2: (quality(200.0, 0.2), table), 3: (quality(None, None), table[1:]), 4: (None, [])}
    stored = spark.createDataFrame([(i, document(*x)) for i, x in given.items()], "response_id bigint, payload string")
    got = {r["doc_id"]: r for r in reference.rebuilt_responses(stored).collect()}
    for i, (meta, rows) in given.items():
        want = [(t[0], t[1], *(float(t[k].split()[0]) for k in (2, 3)), float(t[4]) / 100) for t in rows]
        assert [tuple(x["lines"][k] for k in fields) for x in got[i]["lines"]] == want
        q = (meta or {}).get("quality", {})
        doubts = ["LOW_FOCUS"] * ((q.get("focus") or 99) < 80) + ["HIGH_GLARE"] * ((q.get("glare") or 0) > 0.08)
        assert [w["code"] for w in got[i]["warnings"]] == doubts
    assert (got[1]["meta"]["ocrConfidence"], got[1]["meta"]["uploadHash"], got[1]["meta"]["quality"]["focus"]) == (0.8, "ab", 50.0)
    stored.write.parquet(str(tmp_path / "ocr_responses.parquet"))
    assert {r["doc_id"]: (r["n_lines"], r["n_warnings"]) for r in reference.rich_responses(spark, str(tmp_path)).collect()} == {1: (4, 1), 2: (4, 1), 3: (3, 0), 4: (0, 0)}


def test_folds_are_linear(spark):
    """Rows of a document of 16 times the tokens take about 16 times as long, not 256."""
    import time

    def seconds(n):
        t = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.lit("x").alias("text"), F.lit(1.0).alias("conf"), F.lit(0).alias("page"), (i % 4 * 100.0).alias("cx"), (F.floor(i / 4) * 30.0).alias("cy"), (i % 4 * 100.0).alias("left"), i.alias("idx")))
        df = spark.range(4).select("id", t.alias("t"))
        rows = df.select(F.size(K.rows_by_median(F.col("t"))).alias("a"), F.size(K.rows_by_average(F.col("t"), 10.0)).alias("b"))
        began = time.time()
        assert {tuple(r) for r in rows.collect()} == {(n // 4, n // 4)}
        return time.time() - began

    seconds(1000)
    small, large = min(seconds(1000) for _ in range(2)), min(seconds(16_000) for _ in range(2))
    assert large < 40 * max(small, 0.2)


def test_alignment_and_window_before_a_transposed_table(spark):
    kind = "rows array<array<struct<text: string, conf: double, page: int, cx: double, cy: double, left: double, idx: int>>>"
    place = lambda rs: [[(w, 0.9, 0, float(x), float(y * 40), float(x), 0) for x, w in r] for y, r in enumerate(rs)]
    fields = [[(0, "Quantity"), (100, "4"), (200, "6")], [(0, "Rate"), (105, "10.00"), (190, "20.00")], [(0, "Total"), (100, "160.00")]]
    names = [[(0, "Invoice"), (100, "No"), (200, "7")], [(0, "Brick"), (100, "Twine"), (200, "Rope")]]
    df = spark.createDataFrame([(place(names + fields),), (place([fields[0], [(0, "Rate"), (300, "1.00"), (500, "2.00")]]),), (place([]),)], kind)
    r = df.select(T.is_transposed(F.col("rows")).alias("t"), T.aligned_rows(F.col("rows")).alias("a"), T.parse_transposed(F.col("rows")).alias("x")).collect()
    assert [x["t"] for x in r] == [True, False, False] and r[0]["a"] == 3
    assert [(x["description"], x["quantity"]) for x in r[0]["x"]] == [("Brick", "4"), ("Twine", "6")]


def test_pages_are_stitched(spark):
    """Header from the first page, totals from the last, items of all."""
    from foliospark.operators.extract import extract_invoices

    page = lambda y0, texts: [(t, [[x, y0 + y + 0.0], [x + 50.0, y0 + y + 10.0]], 0.9, None, None, None) for t, x, y in texts]
    one_ = page(0, [("Invoice No.: 7", 100.0, 50), ("Total 1.00", 100.0, 2000)])
    two = page(0, [("Invoice No.: 8", 100.0, 20), ("Total 25.00", 100.0, 90)])
    docs = spark.createDataFrame([(1, [*one_, *two])], OCR_DOCUMENT)
    r = extract_invoices(docs).first()
    assert r["invoice"]["number"] == "7" and r["totals"]["totalAmount"] == D("25.00")


def test_tables_by_the_cheapest_way(spark):
    tok = lambda t, x, y: (t, [[x + 0.0, y + 0.0], [x + 40.0, y + 10.0]], 0.9, None, None, None)
    row = lambda y: [tok("Clay brick", 0, y), tok("6904", 150, y), tok("40 pcs", 300, y), tok("345.00", 450, y), tok("18", 600, y)]
    docs = spark.createDataFrame([(1, [tok("Seller 9 pcs", 0, 10), *row(500), *row(600)], 1000.0), (2, row(500), None), (3, None, 10.0)], OCR_DOCUMENT + ", height double")
    cells = spark.createDataFrame([(2, [0, 20, 50, 29], "Wool", 0.8), (2, [60, 20, 90, 29], "5 kg", 0.8), (2, [100, 20, 120, 29], "2.50", 0.8), (1, [0, 0, 9, 9], "no line", 0.5)], "doc_id bigint, bbox array<int>, text string, conf double")
    got = sorted((r["doc_id"], r["source"], r["description"], r["qty"], r["unitPrice"]) for r in H.extract_tables(docs, cells).collect())
    assert got == [(1, "tokens", "Clay brick", 40.0, 345.0)] * 2 + [(2, "cells", "Wool", 5.0, 2.5)]
    assert {r["doc_id"] for r in H.extract_tables(docs.withColumn("height", F.lit(None).cast("double"))).collect()} == {1, 2}


def test_strokes():
    rng = np.random.default_rng(0)
    blank, scribble = np.full((60, 60), 255), np.full((60, 60), 255)
    x, y = 5.0, 30.0
    for _ in range(400):
        x, y = np.clip(x + rng.normal(0.2, 1), 3, 56), np.clip(y + rng.normal(0, 1.5), 3, 56)
        r = rng.integers(1, 4)
        scribble[int(y) - r : int(y) + r, int(x) - r : int(x) + r] = 0
    assert Q.stroke_features(blank)[0] == 0 and Q.stroke_features(np.zeros((5, 5))) == (0.0, 0.0, 0.0)
    density, spread_, odd = Q.stroke_features(scribble)
    assert density > 0.05 and spread_ > 0.3 and 0 <= odd <= 1
    square = np.full((60, 60), 255)
    square[20:40, 20:40] = 0
    assert 1 < Q.stroke_features(square)[1] < 4


def test_a_reader_is_loaded_once_a_worker(spark, tmp_path):
    def load(folder=str(tmp_path)):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return lambda pdf: pd.DataFrame({"doc_id": pdf["id"], "page": 0, "cell": 0, "bbox": [[0, 0, 1, 1]] * len(pdf), "text": "x", "conf": 0.5})

    from foliospark.sources.readers import CELL_ROWS, first_pages

    assert apply_adapter(spark.range(0, 64, 1, 32), load, CELL_ROWS).count() == 64
    assert len(list(tmp_path.iterdir())) <= 8, "once a worker, not once a partition"
    assert first_pages(spark.range(5).select(F.col("id").alias("page"))).count() == 2


def test_printed_totals_of_stored_responses(spark):
    """The total that a document prints, not its sub total."""
    stored = spark.read.parquet("/root/testdata/sf0.01/ocr_responses.parquet")
    from foliospark.operators.extract import extract_invoices

    docs = stored_documents(stored)
    lines = docs.select("doc_id", F.explode("fullText.text").alias("t")).where(r"t rlike '^Total [0-9,]+\\.[0-9]{2}$'").groupBy("doc_id").agg(F.max(S.amount(F.col("t"))).alias("printed"))
    r = extract_invoices(docs).join(lines, "doc_id").select((F.col("totals.totalAmount") == F.col("printed")).alias("right")).collect()
    assert len(r) > 150 and sum(bool(x["right"]) for x in r) >= 0.99 * len(r)
