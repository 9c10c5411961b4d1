"""Tables rebuilt from rows of tokens: header, columns, items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.scalars import amount, amount_in_text, clean_description, let, spaced_quantity
from foliospark.operators.tokens import row_text, take_until

# Words of a table's header.
HEADER_WORDS = ("description", "hsn", "quantity", "qty", "rate", "amount", "unit price", "taxable")
# Rows in which a header is sought, by two words, by quantity or code, by goods, by decimals, by a full row, and how many rows behind are looked at.
HEADER_ROWS = {"words": (0, 30), "label": (0, 50), "goods": (0, 40), "decimals": (10, 40), "full": (8, 42)}
ROWS_BEHIND = {"label": 9, "goods": 7}
# Ends of a table, labels of fields.
HEADER_ONLY = r"(?i)^\W*(?:(?:item\s+name|description(?:\s+of\s+goods)?|hsn(?:/sac|\s+code)?|quantity|qty|rate|amount|price|unit|gst|taxable|value|item|sl\.?\s*no\.?|s\.?\s*no\.?)\W*)+$"
TOTALS = r"\b(?:total|sub total|amount chargeable|round off|tax amount|amount in words)\b"
QUANTITY = r"(?i)(\d{1,6}(?:\.\d+)?\s*(?:pieces|pcs|bags?|kgs?|nos|units?|box(?:es)?)\b)"
FIELD_LABELS = {"quantity": r"quantity|\bqty\b", "unitPrice": r"\brate\b|\bprice\b", "taxableValue": r"\bamount\b|\btaxable\b", "hsn": r"\bhsn\b"}
ITEM = "struct<description: string, hsn: string, quantity: string, unitPrice: decimal(18,2), taxableValue: decimal(18,2)>"


def keyword_score(text: Column) -> Column:
    """How many different header words a text holds."""
    t = F.lower(text)
    out = F.lit(0)
    for w in HEADER_WORDS:
        out = out + F.contains(t, F.lit(w)).cast("int")
    return out


def _numbers(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)))


def _first(facts: Column, test: Callable[[Column], Column], begin: int, count: int) -> Column:
    """0-based index of the first of ``count`` rows from ``begin`` that passes ``test``, or null."""
    return F.nullif(F.array_position(F.transform(F.slice(facts, begin + 1, count), test), True).cast("int"), F.lit(0)) - 1 + begin


def find_header(rows: Column) -> Column:
    """struct(header, start): the row that shows the columns and the first row of items, or null.

    Tried in order: a row of two header words; a row that names quantity or code, with the columns taken from the first row of figures
    behind it; one that names goods, with the columns from the first full row behind; rows of decimals; a full row.
    """
    facts = F.transform(
        rows,
        lambda r: let(row_text(r), lambda t: F.struct(
            F.lower(t).alias("text"), F.size(r).alias("n"), keyword_score(t).alias("score"), _numbers(t).alias("numbers"), F.size(F.regexp_extract_all(t, F.lit(r"\d+\.\d+"), F.lit(0))).alias("decimals"),
        )),
    )
    return let(facts, _header_of)


def _header_of(facts: Column) -> Column:
    def found(at: Column, start: Callable[[Column], Column]) -> Column:
        return let(at, lambda h: F.when(h.isNotNull(), F.struct(h.cast("int").alias("header"), start(h).cast("int").alias("start"))))

    def behind(label: Column, count: int, test: Callable[[Column], Column], least: int) -> Column:
        def columns(at: Column) -> Column:
            hit = F.array_position(F.transform(F.slice(facts, at + 2, F.lit(count)), test), True).cast("int")
            return F.when(hit > 0, at + hit).when(F.get(facts, at)["n"] >= least, at)

        return let(label, lambda i: F.when(i.isNotNull(), let(columns(i), lambda h: F.when(h.isNotNull(), F.struct(h.cast("int").alias("header"), (i + 1).cast("int").alias("start"))))))

    return F.coalesce(
        found(_first(facts, lambda f: (f["score"] >= 2) & (f["n"] >= 3), *HEADER_ROWS["words"]), lambda h: h + 1),
        behind(_first(facts, lambda f: f["text"].rlike("quantity|hsn/sac|hsn code"), *HEADER_ROWS["label"]), ROWS_BEHIND["label"], lambda f: (f["numbers"] >= 2) & (f["n"] >= 3), 3),
        behind(_first(facts, lambda f: f["text"].rlike("description of goods|item name"), *HEADER_ROWS["goods"]), ROWS_BEHIND["goods"], lambda f: f["n"] >= 4, 0),
        found(_first(facts, lambda f: (f["decimals"] >= 3) & (f["n"] >= 3), *HEADER_ROWS["decimals"]), lambda h: h),
        found(_first(facts, lambda f: f["n"] >= 4, *HEADER_ROWS["full"]), lambda h: h),
    )


def column_bounds(lefts: Column, margin: float = 12.0, narrowest: float = 60.0) -> Column:
    """Intervals (l, r) of columns around sorted left edges, cut half way between them and widened by ``margin``.

    Fewer than three edges are one column.  A column narrower than ``narrowest`` goes to the one before.
    """
    far = 1e6

    def cut(s: Column) -> Column:
        n = F.size(s)
        mids = F.when(n > 1, F.zip_with(F.slice(s, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(s, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: (a + b) / 2)).otherwise(F.array().cast("array<double>"))
        raw = let(mids, lambda m: F.zip_with(F.concat(F.array(F.lit(-far)), m), F.concat(m, F.array(F.lit(far))), lambda a, b: F.struct((a - margin).alias("l"), (b + margin).alias("r"))))
        merged = F.aggregate(
            raw, F.array().cast("array<struct<l: double, r: double>>"),
            lambda a, c: F.when((F.size(a) > 0) & (c["r"] - c["l"] - 2 * margin < narrowest), F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.element_at(a, -1)["l"].alias("l"), c["r"].alias("r"))))).otherwise(F.concat(a, F.array(c))),
        )
        return F.when(n >= 3, merged).otherwise(F.array(F.struct(F.lit(-far).alias("l"), F.lit(far).alias("r"))))

    return let(F.array_sort(lefts), cut)


def column_of(cx: Column, bounds: Column) -> Column:
    """0-based column of a centre: the first interval that holds it, else the one whose middle is nearest."""
    inside = F.array_position(F.transform(bounds, lambda b: (b["l"] <= cx) & (cx <= b["r"])), True).cast("int")
    nearest = F.array_min(F.transform(bounds, lambda b, i: F.struct(F.abs(cx - (b["l"] + b["r"]) / 2).alias("d"), i.alias("i"))))["i"]
    return let(inside, lambda at: F.when(at > 0, at - 1).otherwise(nearest))


def nearest_center(x: Column, centers: Column) -> Column:
    """0-based index of the nearest centre, the lowest of equals."""
    return F.array_min(F.transform(centers, lambda c, i: F.struct(F.abs(x - c).alias("d"), i.alias("i"))))["i"]


def row_columns(row: Column, bounds: Column) -> Column:
    """Texts of a row's columns."""
    placed = F.transform(row, lambda t: F.struct(t["text"].alias("text"), column_of(t["cx"], bounds).alias("c")))
    return let(placed, lambda ps: F.transform(F.sequence(F.lit(0), F.size(bounds) - 1), lambda i: F.trim(F.concat_ws(" ", F.transform(F.filter(ps, lambda p: p["c"] == i), lambda p: p["text"])))))


def _item(columns: Column, amounts: Column, before: Column) -> Column:
    """A flat item from a row's column texts, their amounts and the description lines before it."""

    def build(f: Column) -> Column:
        stop = F.least(F.nullif(F.array_position(F.transform(amounts, lambda a: a.isNotNull()), True).cast("int"), F.lit(0)), F.nullif(F.array_position(F.transform(f["coded"], lambda c: c != ""), True).cast("int"), F.lit(0)))
        own = let(stop, lambda i: F.when(i > 1, F.slice(columns, F.lit(1), i - 1)))
        words = F.concat_ws(" ", before, F.coalesce(own, F.array().cast("array<string>")))
        description = clean_description(F.regexp_replace(F.regexp_replace(words, QUANTITY, " "), r"^\s*\d{1,3}[.)]?\s+(?=\D)", ""))
        return F.struct(
            description.alias("description"), F.try_element_at(F.filter(f["coded"], lambda c: c != ""), F.lit(1)).alias("hsn"),
            spaced_quantity(F.trim(F.try_element_at(F.filter(f["counted"], lambda q: q != ""), F.lit(1)))).alias("quantity"),
            F.when(f["at"] >= 1, F.get(amounts, f["at"] - 1)).alias("unitPrice"), F.get(amounts, f["at"]).alias("taxableValue"),
        ).cast(ITEM)

    facts = F.struct(
        F.array_max(F.filter(F.transform(amounts, lambda a, i: F.when(a.isNotNull(), i)), lambda i: i.isNotNull())).alias("at"),
        F.transform(columns, lambda c: F.regexp_extract(c, r"^\s*(\d{4,8})\b", 1)).alias("coded"), F.transform(columns, lambda c: F.regexp_extract(c, QUANTITY, 1)).alias("counted"),
    )
    return let(facts, build)


def parse_table(rows: Column, found: Column, margin: float = 12.0, narrowest: float = 60.0) -> Column:
    """Flat items of the table that ``find_header`` found, up to its totals.

    A row without an amount is a description line of the next row that has one, unless it is only figures.
    """
    body = take_until(F.slice(rows, found["start"] + 1, F.greatest(F.size(rows) - found["start"], F.lit(0))), TOTALS)
    held = lambda r: ~(r["text"].rlike(r"^[\d\s.,]+$") | r["text"].rlike(HEADER_ONLY) | (r["score"] >= 2))

    def items(bounds: Column) -> Column:
        read = F.transform(body, lambda r: let(row_columns(r, bounds), lambda c: F.struct(c.alias("columns"), F.transform(c, amount_in_text).alias("amounts"), row_text(r).alias("text"))))
        scored = F.transform(read, lambda r: F.struct(r["columns"].alias("columns"), r["amounts"].alias("amounts"), r["text"].alias("text"), keyword_score(r["text"]).alias("score")))
        return let(scored, priced)

    def priced(rs: Column) -> Column:
        # An item is a row with an amount and the rows between it and the one before: the rows are cut at those places, none is carried along.
        at = F.filter(F.transform(rs, lambda r, i: F.when(F.exists(r["amounts"], lambda a: a.isNotNull()), i)), lambda i: i.isNotNull())

        def item(end: Column, before: Column) -> Column:
            lines = F.transform(F.filter(F.slice(rs, before + 2, end - before - 1), held), lambda r: r["text"])
            return let(F.get(rs, end), lambda r: _item(r["columns"], r["amounts"], lines))

        return let(at, lambda ends: F.transform(ends, lambda end, k: item(end, F.coalesce(F.get(ends, k - 1), F.lit(-1)))))

    edges = column_bounds(F.transform(F.get(rows, found["header"]), lambda t: t["left"]), margin, narrowest)
    # One column is no table; its lines are read as text.
    several = found.isNotNull() & (F.size(F.get(rows, found["header"])) >= 3)
    return F.when(several, let(edges, items)).otherwise(F.array().cast(f"array<{ITEM}>"))


def parse_item_line(text: Column) -> Column:
    """A flat item from one line of text: the last amount is its value, the one before its price; null without an amount or a number.

    The quantity is the first number with a unit, else the first whole number that is no code.
    """
    money = r"(?<![\d.])\d+\.\d{2}(?!\d)"

    def build(f: Column) -> Column:
        code = F.regexp_extract(f["bare"], r"(?<!\d)(\d{4,8})(?!\d)", 1)
        quantity = F.coalesce(F.nullif(F.regexp_extract(f["bare"], QUANTITY, 1), F.lit("")), F.nullif(F.regexp_extract(f["bare"], r"(?<!\d)(\d{1,3})(?!\d)", 1), F.lit("")))
        description = clean_description(F.regexp_replace(F.regexp_replace(F.regexp_replace(f["bare"], QUANTITY, " "), r"(?<!\d)\d{4,8}(?!\d)", " "), r"^\s*\d{1,3}[.)]?\s+", ""))
        last = lambda i: F.try_element_at(f["amounts"], F.lit(i)).cast("decimal(18,2)")
        item = lambda q: F.struct(description.alias("description"), F.nullif(code, F.lit("")).alias("hsn"), spaced_quantity(F.trim(q)).alias("quantity"), last(-2).alias("unitPrice"), last(-1).alias("taxableValue"))
        return let(quantity, lambda q: F.when((F.size(f["amounts"]) >= 1) & q.isNotNull(), item(q).cast(ITEM)))

    plain = F.regexp_replace(text, "[₹,]", "")
    facts = let(plain, lambda t: F.struct(F.regexp_extract_all(t, F.lit(money), F.lit(0)).alias("amounts"), F.regexp_replace(t, money + r"|\(?@?\d+(?:\.\d+)?\s?%\)?", " ").alias("bare")))
    return let(facts, build)


def merge_lines(lines: Column, ahead: int = 2) -> Column:
    """Flat items from text lines: a line that makes no item takes up to ``ahead`` lines behind it along; lines are used once."""
    none = F.array().cast(f"array<{ITEM}>")
    start = F.struct(F.array().cast("array<string>").alias("held"), none.alias("items"), F.lit(False).alias("over"))

    def step(s: Column, line: Column) -> Column:
        over = s["over"] | F.lower(line).rlike(TOTALS)
        rest = F.concat(s["held"], F.array(line))
        short = F.when(F.size(rest) > ahead, F.slice(rest, F.lit(2), F.size(rest) - 1)).otherwise(rest)
        return let(parse_item_line(F.concat_ws(" ", rest)), lambda item: F.struct(
            F.when(over | item.isNotNull(), F.array().cast("array<string>")).otherwise(short).alias("held"),
            F.when(~over & item.isNotNull(), F.concat(s["items"], F.array(item))).otherwise(s["items"]).alias("items"), over.alias("over"),
        ))

    return F.aggregate(lines, start, step, lambda s: s["items"])


# Words of a row that describes no goods.
NO_GOODS = r"invoice|buyer|seller|gstin|state name|bill to"
#: Rows before a transposed table's first field in which its names stand.
ROWS_BEFORE = 10


def _label(row: Column, pattern: str) -> Column:
    return F.coalesce(F.lower(F.get(row, F.lit(0))["text"]).rlike("^(?:" + pattern + ")"), F.lit(False))


def aligned_rows(rows: Column, within: float = 20.0, share: float = 0.8, look: int = 15, most: int = 5) -> Column:
    """How many of the first ``most`` rows of three or more tokens, among the first ``look``, have the length of the first of them and ``share`` of their left edges ``within`` of its."""
    wide = F.slice(F.filter(F.slice(rows, 1, look), lambda r: F.size(r) >= 3), 1, most)

    def count(ws: Column) -> Column:
        first = F.get(ws, F.lit(0))
        near = lambda r: F.size(F.filter(F.zip_with(r, first, lambda a, b: F.abs(a["left"] - b["left"]) < within), lambda x: x))
        return F.size(F.filter(F.slice(ws, 2, most), lambda r: (F.size(r) == F.size(first)) & (near(r) >= share * F.size(first))))

    return let(wide, count)


def is_transposed(rows: Column) -> Column:
    """Whether a table has its fields as rows: at least two field labels lead rows of three or more tokens, and of those rows one lines up with the first.

    Rows that line up alone are no evidence: those of an ordinary table do.
    """
    led = F.filter(rows, lambda r: (F.size(r) >= 3) & _label(r, "|".join(FIELD_LABELS.values())))
    leads = lambda pattern: F.exists(led, lambda r: _label(r, pattern)).cast("int")
    several = sum((leads(p) for p in FIELD_LABELS.values()), F.lit(0)) >= 2
    return several & (aligned_rows(led) >= 1)


def parse_transposed(rows: Column) -> Column:
    """Flat items of a transposed table: item i takes the i-th figure of each field's row, up to the totals.

    Names stand in a row with a label, else in the last row of three or more tokens among the ten before the first field that speaks of no party or invoice.
    """
    anything = "|".join(FIELD_LABELS.values())

    def items(rs: Column) -> Column:
        first = F.array_position(F.transform(rs, lambda r: (F.size(r) >= 2) & _label(r, anything)), True).cast("int")
        before = F.slice(rs, F.greatest(first - ROWS_BEFORE, F.lit(1)), F.least(first - 1, F.lit(ROWS_BEFORE)))
        goods = F.when(first > 1, F.try_element_at(F.filter(before, lambda r: (F.size(r) >= 3) & ~F.lower(row_text(r)).rlike(NO_GOODS)), F.lit(-1)))

        def field(pattern: str) -> Column:
            row = F.try_element_at(F.filter(rs, lambda r: _label(r, pattern)), F.lit(1))
            return F.transform(F.when(F.size(row) > 1, F.slice(row, F.lit(2), F.size(row) - 1)), lambda t: t["text"])

        values = {k: F.coalesce(field(p), F.array().cast("array<string>")) for k, p in FIELD_LABELS.items()}
        names = F.coalesce(field(r"description|item|particulars"), F.transform(goods, lambda t: t["text"]), F.array().cast("array<string>"))
        n = F.greatest(*(F.size(v) for v in values.values()), F.lit(1))
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(F.get(names, i).alias("description"), F.get(values["hsn"], i).alias("hsn"), F.get(values["quantity"], i).alias("quantity"), amount(F.get(values["unitPrice"], i)).alias("unitPrice"), amount(F.get(values["taxableValue"], i)).alias("taxableValue")).cast(ITEM),
        )

    return let(take_until(rows, r"\b(?:total|sub total|amount chargeable)\b"), items)


def valid_items(items: Column) -> Column:
    """Items that have a value, a price or a code."""
    return F.filter(items, lambda x: (F.coalesce(x["taxableValue"], F.lit(0)) != 0) | (F.coalesce(x["unitPrice"], F.lit(0)) != 0) | (F.coalesce(x["hsn"], F.lit("")) != ""))
