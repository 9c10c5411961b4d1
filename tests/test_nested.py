"""Nested responses to node tables."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.operators.nested import CHILD_TYPES, child_records, find_response, label_nodes, node_table

DOC = {
    "meta": {"ocrConfidence": 0.9, "quality": {}},
    "lines": [
        {"rowId": "r1", "description": {"value": "a", "alts": ["x", None, "y"]}, "qty": {"value": "1", "alts": "2"}},
        None, {}, {"rowId": "r4", "qty": {"alts": []}},
    ],
    "warnings": [], "fullText": [{"text": "t", "bbox": [[1, 2], [3, 4]]}, {}, None, {"text": "u"}], "unknown": [[1, [2]]],
}
WANT = {("meta", -1, 0), ("lines", -1, 0), ("lines", -1, 3), ("lines.description.alts", 0, 0), ("lines.description.alts", 0, 2), ("lines.qty.alts", 0, 0), ("fullText", -1, 0), ("fullText", -1, 3)}


def brute(doc):
    out = set()
    real = lambda x: x is not None and x != {} and x != []
    listed = lambda x: x if isinstance(x, list) else [] if x is None else [x]
    if real(doc.get("meta")):
        out.add(("meta", -1, 0))
    for k in ("lines", "fullText", "warnings"):
        for i, x in enumerate(listed(doc.get(k))):
            if real(x):
                out.add((k, -1, i))
            if k == "lines" and isinstance(x, dict):
                for f in ("description", "qty"):
                    if isinstance(x.get(f), dict):
                        out |= {(f"lines.{f}.alts", i, j) for j, a in enumerate(listed(x[f].get("alts"))) if real(a)}
    return out


def rows(spark, payloads, **more):
    df = spark.createDataFrame([(i, p) for i, p in payloads], "response_id bigint, payload string")
    for c, v in more.items():
        df = df.withColumn(c, F.lit(v))
    return df


@pytest.mark.parametrize("wrap", [
    lambda s: s, lambda s: json.dumps(s), lambda s: json.dumps(json.dumps(s)), lambda s: f"[{s}]", lambda s: '{"status":200,"data":' + s + "}", lambda s: "﻿ " + s,
    lambda s: json.dumps({"result": s}), lambda s: "callback(" + s + ");", lambda s: json.dumps("[" + s + "]"), lambda s: '{"a":{"b":[' + s + "]}}",
])
def test_any_wrapping(wrap):
    assert brute(find_response(wrap(json.dumps(DOC)))) == WANT


@pytest.mark.parametrize("bad", [None, "", " ", "null", "17", "<html>502</html>", json.dumps(DOC)[:-5], json.dumps(json.dumps(DOC)[:-5]), "[]", "{", '{"status":500,"data":null}', "[" * 5000])
def test_no_complete_response(bad):
    assert find_response(bad) is None


def test_children_links_and_intervals(spark):
    n = label_nodes(rows(spark, [(1, json.dumps(DOC)), (1, json.dumps(DOC)), (2, None), (None, json.dumps(DOC)), (3, "x")], copy="clash", pre=5, pos=1), with_body=True).collect()
    got = {(r["node_type"], r["line_pos"], r["pos"]) for r in n if r["node_type"] in CHILD_TYPES}
    assert got == WANT and {r["parent_pre"] for r in n} <= {-1, *(r["pre"] for r in n)}, "every link leads to a row"
    by = {r["pre"]: r for r in n}
    for r in n:
        if r["node_type"] == "response":
            continue
        root = by[0]
        assert root["pre"] < r["pre"] < r["post"] < root["post"]
        if r["node_type"].endswith("alts"):
            around = [x for x in n if x["node_type"] == "lines" and x["pre"] < r["pre"] and r["post"] < x["post"]]
            assert [x["pos"] for x in around] == [r["line_pos"]]
    spans = sorted((r["pre"], r["post"]) for r in n)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert c > b or d < b, "intervals nest or are disjoint"


def test_long_and_deep_payload(spark):
    deep = {"meta": {"x": 1}, "lines": [{"rowId": str(i)} for i in range(3000)], "fullText": [{"text": "a" * 200_000}]}
    got = child_records(label_nodes(rows(spark, [(1, json.dumps(deep))]))).groupBy("child").count().collect()
    assert {r["child"]: r["count"] for r in got} == {"meta": 1, "lines": 3000, "fullText": 1}


def test_copies_that_differ_and_empty_table(spark):
    a, b = json.dumps({"lines": [{"rowId": "1"}]}), json.dumps({"lines": [{"rowId": "1"}, {"rowId": "2"}]})
    df = spark.createDataFrame([(1, b, "2024-01-02"), (1, a, "2024-01-01")], "response_id bigint, payload string, stored_at string")
    assert child_records(label_nodes(df)).count() == 1
    assert label_nodes(df.where("false")).count() == 0


def test_stored_pages_agree_with_a_plain_walk(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/ocr_responses.parquet")
    want = set()
    for r in df.collect():
        doc = find_response(r["payload"])
        want |= {(r["response_id"], *x) for x in brute(doc)} if doc else set()
    assert {tuple(r) for r in child_records(label_nodes(df)).collect()} == want


def test_thin_and_whole_walks_label_alike(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/ocr_responses.parquet")
    keys = ["response_id", "node_type", "pre", "post", "depth", "pos", "line_pos"]
    whole = label_nodes(df, with_body=True)
    kept = whole.where(F.col("node_type").isin("response", *CHILD_TYPES))
    assert {tuple(r) for r in kept.select(keys).collect()} == {tuple(r) for r in label_nodes(df).select(keys).collect()}
    # Every link leads to a node that encloses the row.
    up = whole.select("response_id", F.col("pre").alias("parent_pre"), F.col("post").alias("parent_post"))
    assert whole.where("parent_pre >= 0").join(up, ["response_id", "parent_pre"], "left").where("parent_post is null or parent_post <= post").count() == 0
    qty = node_table(whole, "lines.qty", "value string, unit string, confidence double")
    assert qty.where("confidence is not null").count() > 0 and qty.columns[-3:] == ["value", "unit", "confidence"]


def test_wrappers_and_values_of_any_depth(spark):
    doc = json.dumps(DOC)
    wrapped = doc
    for i in range(40):
        wrapped = "[" + wrapped + "]" if i % 2 else '{"a":' + wrapped + "}"
    assert brute(find_response(wrapped)) == WANT
    far = "[" * 5000 + doc + "]" * 5000
    inside = '{"lines":[{"rowId":"r\\"1","x":' + '{"y":[' * 4000 + '"z"' + "]}" * 4000 + "}]}"
    assert brute(find_response(far)) == WANT and find_response(far[:-1]) is None
    got = [(r["node_type"], r["pos"]) for r in child_records(label_nodes(rows(spark, [(1, inside)]))).select(F.col("child").alias("node_type"), "pos").collect()]
    assert got == [("lines", 0)]
    nodes = label_nodes(rows(spark, [(1, inside)]), with_body=True)
    assert nodes.count() == 8003 and nodes.where("node_type = 'lines'").first()["body"] == '{"rowId":"r\\"1"}'
