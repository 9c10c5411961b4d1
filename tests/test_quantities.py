"""Recorded quantities and unit changes."""

from decimal import Decimal as D

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.operators.quantities import Segmenter, _amount, content_of, normalize_quantities, penalised_segments, plain_number, read_amount, unit_factors, unit_kind, unit_shifts
from foliospark.plans.core_queries import p5_unit_shifts

UNITS = "/root/testdata/sf0.001/unit_codes.parquet"


@pytest.fixture(scope="module")
def factors(spark):
    return unit_factors(spark.read.parquet(UNITS))


@pytest.mark.parametrize("text,want", [
    ("1,234.5", "1234.5"), ("1.234,5", "1234.5"), ("1,234", "1234"), ("3,1", "3.1"), ("41,48", "41.48"), ("1,00,000", "100000"), ("12.345", "12.345"), ("1.234.567", "1234567"), ("1.731,433", "1731.433"), ("7", "7"),
])
def test_notations(text, want):
    assert plain_number(text) == D(want)


@pytest.mark.parametrize("value,unit,raw,description,want", [
    ("149 Bag", None, None, "PLASTER 25 KG", ("g", 3725000)), ("4", "box", None, "Pens, pack of 12", ("pcs", 48)), ("4", "box", None, "Pens", None), ("4", "lot", None, "x", None), (None, None, None, None, None),
    ("", "kg", None, "x", None), ("nil", "kg", None, "x", None), ("12", None, None, "x", None), ("12", None, "12x250gms", "x", ("g", 3000)), ("27 Ft. 3 inches", None, None, "x", ("mm", 8306)), ("51 KGS 500 gram", None, None, "x", ("g", 51500)),
    ("7¼", "kg", None, "x", ("g", 7250)), ("30 1/2", "mt", None, "x", ("g", 30500000)), ("5 lakh nos.", None, None, "x", ("pcs", 500000)), ("38 '000 pieces", None, None, "x", ("pcs", 38000)), ("7 k pcs", None, None, "x", ("pcs", 7000)),
    ("I60", "pcs", None, "x", ("pcs", 160)), ("14O.927", "kg", None, "x", ("g", 140927)), ("8L", None, None, "x", ("ml", 8000)), ("113.472OZ", None, None, "x", ("g", 3217)), ("94.7", None, "Qty(litre): 94.7", "x", ("ml", 94700)),
    ("2", None, "Quantity in Quintals 2", "x", ("g", 200000)), ("605", None, None, "Sugar, measured in Kilograms", ("g", 605000)), ("9", None, None, "Rope [mtr]", ("mm", 9000)), ("3", None, None, "Copper cable 3 core", None),
    ("19", "kg", None, "Zinc 25 KG", ("g", 19000)), ("5", "set", None, "x", None), ("4", "hundred pcs", None, "x", ("pcs", 400)), ("210", '"', None, "x", ("mm", 5334)), ("0.5", "g", None, "x", ("g", 1)), ("1I qtl", None, None, "x", ("g", 1100000)),
])
def test_amounts(factors, value, unit, raw, description, want):
    assert _amount(value, unit, raw, description, factors) == want


def test_contents():
    assert content_of("Oil @ 2.5 gal each") == (D("2.5"), "gal") and content_of("Paper 1x10") is None and content_of("Hinge 10's pack") == (10, "pcs") and content_of("Twine, 25-k.g.") == (25, "kg")


def test_unit_texts():
    assert unit_kind("K.G.") == ("unit", "kg", 1) and unit_kind("lac nos") == ("unit", "pcs", 100_000) and unit_kind("job")[0] == "vague" and unit_kind(" ") is None


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_any_text_is_read(text):
    read_amount(text)
    unit_kind(text)
    content_of(text)


def test_table_edges(spark):
    schema = "line_id bigint, qty_value string, qty_unit string, qty_raw string, description string, base_unit string"
    long = "Sugar " + "x" * 100_000
    df = spark.createDataFrame([(1, "2", "kg", None, long, "clash"), (1, "2", "kg", None, long, "clash"), (2, "9" * 40, "t" * 3, None, None, ""), (3, "9" * 30, "tonne", None, None, ""), (None, "1", "kg", None, None, "")], schema)
    units = spark.read.parquet(UNITS)
    assert [tuple(r) for r in normalize_quantities(df, units).collect()] == [(1, "g", 2000)]
    assert normalize_quantities(df.where("false"), units).count() == 0


def brute_segments(x, penalty):
    n = len(x)
    cost = lambda a, b: ((x[a:b] - x[a:b].mean()) ** 2).sum() + penalty
    best, back = [0.0] + [np.inf] * n, [0] * (n + 1)
    for t in range(1, n + 1):
        for s in range(t):
            if best[s] + cost(s, t) < best[t] - 1e-12:
                best[t], back[t] = best[s] + cost(s, t), s
    return best[n] - penalty if n else 0.0


def test_segmentation_is_exact():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40, 90):
        x = rng.normal(0, 1, n) + np.repeat(rng.normal(0, 4, n // 10 + 1), 10)[:n]
        starts = penalised_segments(x, 3.0)
        parts = np.split(x, starts[1:])
        assert abs(sum(((p - p.mean()) ** 2).sum() + 3.0 for p in parts) - 3.0 - brute_segments(x, 3.0)) < 1e-6
    assert penalised_segments(np.array([]), 1.0) == []


def test_unit_change_is_found_and_reversed(spark):
    rng = np.random.default_rng(1)
    v = np.exp(rng.normal(1, 0.2, 300))
    v[100:160] *= 1000
    rows = [("a", i, float(x)) for i, x in enumerate(v)] + [("b", i, 5.0) for i in range(50)] + [("b", 60, None), (None, 1, 2.0), ("b", 61, -1.0), ("b", 62, float("inf"))]
    got = unit_shifts(spark.createDataFrame(rows, "source string, at bigint, value double"), [1000.0, 12.0], penalty=4.0).collect()
    changed = [r for r in got if r["unit_change"]]
    assert [(r["source"], r["first_at"], r["last_at"]) for r in changed] == [("a", 100, 159)] and abs(changed[0]["factor"] - 0.001) < 1e-9
    assert sum(r["n"] for r in got if r["source"] == "b") == 50
    assert unit_shifts(spark.createDataFrame([], "source string, at bigint, value double"), [10.0]).count() == 0


def test_history_is_segmented_whole(spark):
    rng = np.random.default_rng(3)
    # A change behind row 4096, 9000 rows of one level before it; few rows of another source between the partitions.
    x = np.concatenate([rng.normal(2, 0.1, 9000), rng.normal(2 + np.log(1000), 0.1, 5000)])
    rows = [("a", i, float(v)) for i, v in enumerate(np.exp(x))] + [("b", i, 5.0 if i % 100 < 50 else 5000.0) for i in range(300)]
    df = spark.createDataFrame(rows, "source string, at bigint, value double").repartition(7)
    for block in (64, 4096):
        got = sorted(map(tuple, unit_shifts(df, [1000.0], block=block).select("source", "segment", "first_at", "last_at", "n", "unit_change").collect()))
        assert [r for r in got if r[0] == "a"] == [("a", 0, 0, 8999, 9000, False), ("a", 1, 9000, 13999, 5000, True)]
        assert [r[2:5] for r in got if r[0] == "b"] == [(i, i + 49, 50) for i in range(0, 300, 50)]


def test_base_is_the_level_of_most_rows(spark):
    # 5 x 60 rows in kg, between them one longer run in g.
    parts = [4.0] * 60 + [4000.0] * 200 + [4.0] * 60 + [900_000.0] * 30 + [4.0] * 60 + [900_000.0] * 30 + [4.0] * 60 + [900_000.0] * 30 + [4.0] * 60
    got = unit_shifts(spark.createDataFrame([("a", i, v) for i, v in enumerate(parts)], "source string, at bigint, value double"), [1000.0]).where("unit_change").collect()
    assert [(r["first_at"], r["last_at"], round(r["factor"], 6)) for r in got] == [(60, 259, 0.001)]


def test_search_in_steps_equals_the_whole():
    rng = np.random.default_rng(8)
    for n, penalty in ((1, 1.0), (300, 0.5), (9000, 3.0), (9000, 12.0)):
        x = rng.normal(0, 1, n) + np.repeat(rng.normal(0, 2, n // 40 + 1), 40)[:n]
        search, got = Segmenter(penalty), []
        for i, v in enumerate(x.tolist()):
            search.add(i, v)
            got += search.settled() if i % 100 == 0 else []
        got += search.rest()
        assert [g[0] for g in got] == penalised_segments(x, penalty) and sum(g[2] for g in got) == n


def test_history_has_the_recorded_numbers(spark, tmp_path):
    rows = [("24,5", None, 24.5), ("1,250", None, 1250.0), ("19*5 m", None, 95.0), ("9¼", None, 9.25), (None, "14 kg", 14.0), ("nil", "3,1 kg", 3.1), ("I60", None, 160.0), ("6 kilo 500 grams", None, 6.5), (None, None, None)]
    lines = spark.createDataFrame([(i, i, "Clay brick", v, r) for i, (v, r, _) in enumerate(rows)], "line_id bigint, vendor_id bigint, description string, qty_value string, qty_raw string")
    lines.write.parquet(str(tmp_path / "line_items.parquet"))
    spark.read.parquet(UNITS).write.parquet(str(tmp_path / "unit_codes.parquet"))
    got = {r["first_at"]: r["level"] for r in p5_unit_shifts(spark, str(tmp_path)).collect()}
    assert got == {i: pytest.approx(np.log(want)) for i, (_, _, want) in enumerate(rows) if want}


def test_planted_unit_changes(spark):
    """Of 120 histories half change their unit for a while: what is marked is what was planted, whatever the partitions."""
    rng = np.random.default_rng(7)
    rows, planted = [], set()
    for s in range(120):
        level, n = rng.uniform(0, 6), 200
        begin = int(rng.integers(20, 120))
        for i in range(n):
            changed = s % 2 == 0 and begin <= i < begin + 60
            rows.append((f"s{s}", i, float(np.exp(level + rng.normal(0, 0.5)) * (1000.0 if changed else 1.0))))
            if changed:
                planted.add((f"s{s}", i))
    df = spark.createDataFrame(rows, "source string, at bigint, value double")
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("1", "3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        seen.append(sorted(tuple(r) for r in unit_shifts(df.repartition(int(partitions)), [1000.0]).select("source", "segment", "first_at", "last_at", "unit_change").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]
    marked = {(s, i) for s, _, a, b, change in seen[0] if change for i in range(a, b + 1)}
    assert len(marked & planted) >= 0.98 * len(planted) and len(marked & planted) >= 0.98 * len(marked)
    print("recall", len(marked & planted) / len(planted), "precision", len(marked & planted) / len(marked))
