"""Text tokens with geometry: reading order, pages, rows and regions.

A document's tokens stay one array, so what depends on their order runs as higher-order functions in one stage without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.scalars import center, confidence, extent, let

GEOMETRY = "text: string, conf: double, page: int, cx: double, cy: double, left: double, idx: int"
_TOKEN = f"struct<{GEOMETRY}>"


def geometry_tokens(full_text: Column, page_drop: float = 1000.0) -> Column:
    """Tokens with centre, left edge, confidence, position and page, sorted by page, height and left edge.

    Tokens without text or box are left out.  A new page begins where the centre falls by more than ``page_drop`` in input order.
    Null gives an empty array.
    """
    kept = F.filter(
        F.transform(F.coalesce(full_text, F.array()), lambda t, i: F.struct(F.trim(t["text"]).alias("text"), t["bbox"].alias("bbox"), confidence(t["conf"], t["confidence"]).alias("conf"), i.alias("idx"))),
        lambda t: (F.length(t["text"]) > 0) & (F.size(t["bbox"]) > 0),
    )
    measured = F.transform(kept, lambda t: let(center(t["bbox"]), lambda c: F.struct(t["text"].alias("text"), t["conf"].alias("conf"), c["cx"].alias("cx"), c["cy"].alias("cy"), extent(t["bbox"])["left"].alias("left"), t["idx"].alias("idx"))))

    def paged(ts: Column) -> Column:
        falls = lambda t, i: let(F.get(ts, i - 1)["cy"], lambda last: F.when((i > 0) & (last > 0) & (t["cy"] < last - page_drop), i))
        breaks = F.filter(F.transform(ts, falls), lambda i: i.isNotNull())
        # What orders comes first, so that tokens sort by their natural order.
        keyed = let(breaks, lambda bs: F.transform(ts, lambda t, i: F.struct(F.size(F.filter(bs, lambda b: b <= i)).alias("page"), t["cy"].alias("cy"), t["left"].alias("left"), t["idx"].alias("idx"), t["text"].alias("text"), t["conf"].alias("conf"), t["cx"].alias("cx"))))
        return F.transform(F.array_sort(keyed), _token)

    return let(measured, paged)


def _token(t: Column) -> Column:
    return F.struct(*(t[k].alias(k) for k in ("text", "conf", "page", "cx", "cy", "left", "idx")))


def _rows_from(tokens: Column, start: Column, step: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """Rows of sorted tokens, each sorted by left edge; ``step(state, token, tokens, i)`` gives the state behind token i, whose ``starts`` lists where rows begin.

    The fold carries places only: no token is copied until rows are cut.
    """

    def cut(ts: Column) -> Column:
        last = F.size(ts) - 1
        starts = F.when(last >= 0, F.aggregate(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), start, lambda s, i: step(s, F.get(ts, i), ts, i), lambda s: s["starts"])).otherwise(F.array().cast("array<int>"))
        sliced = let(starts, lambda at: F.transform(at, lambda a, k: F.slice(ts, a + 1, F.coalesce(F.get(at, k + 1), last + 1) - a)))
        keyed = lambda r: F.transform(r, lambda t: F.struct(t["left"].alias("left"), t["idx"].alias("idx"), t["text"].alias("text"), t["conf"].alias("conf"), t["page"].alias("page"), t["cx"].alias("cx"), t["cy"].alias("cy")))
        return F.transform(sliced, lambda r: F.transform(F.array_sort(keyed(r)), _token))

    return let(tokens, cut)


def rows_by_median(tokens: Column, tolerance: float = 16.0) -> Column:
    """Rows of sorted tokens: a token joins the last row if its centre is within ``tolerance`` of that row's median; rows sorted by left edge."""
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("first"))

    def step(s: Column, t: Column, ts: Column, i: Column) -> Column:
        # Tokens come sorted by height, so the middle ones of a row are at its middle.
        first, n = s["first"], i - s["first"]
        middle = (F.get(ts, first + ((n - 1) / 2).cast("int"))["cy"] + F.get(ts, first + (n / 2).cast("int"))["cy"]) / 2
        joins = (i > 0) & (F.abs(t["cy"] - middle) <= tolerance) & (F.get(ts, first)["page"] == t["page"])
        return F.when(joins, s).otherwise(F.struct(F.concat(s["starts"], F.array(i)).alias("starts"), i.alias("first")))

    return _rows_from(tokens, start, step)


def rows_by_average(tokens: Column, threshold: float = 30.0) -> Column:
    """Rows of sorted tokens by a running pair average: a token joins if within ``threshold`` of it, and the average moves half way."""
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0.0).alias("y"))

    def step(s: Column, t: Column, ts: Column, i: Column) -> Column:
        joins = (i > 0) & (F.abs(t["cy"] - s["y"]) < threshold)
        return F.struct(F.when(joins, s["starts"]).otherwise(F.concat(s["starts"], F.array(i))).alias("starts"), F.when(joins, (s["y"] + t["cy"]) / 2).otherwise(t["cy"]).alias("y"))

    return _rows_from(tokens, start, step)


def row_bucket(cy: Column, size: int = 10) -> Column:
    """The height of a cell to the nearest multiple of ``size``, halves to even."""
    return (F.bround(cy / size) * size).cast("int")


def row_text(row: Column) -> Column:
    """A row's texts joined by blanks."""
    return F.concat_ws(" ", F.transform(row, lambda t: t["text"]))


def full_text(rows: Column) -> Column:
    """All rows' texts, one a line."""
    return F.concat_ws("\n", F.transform(rows, row_text))


def blocks(rows: Column, top: int = 5, bottom: int = 14, middle: int = 20) -> Column:
    """struct(top, mid, bottom): the first rows, those behind them on the first page, and the last."""
    first = F.filter(rows, lambda r: F.get(r, F.lit(0))["page"] == 0)
    n = F.size(rows)
    return F.struct(
        F.slice(first, 1, top).alias("top"), F.slice(first, top + 1, middle).alias("mid"), F.when(n > 0, F.slice(rows, F.greatest(F.lit(1), n - bottom + 1), F.lit(bottom))).otherwise(rows).alias("bottom")
    )


def take_until(rows: Column, stop: str) -> Column:
    """The rows before the first whose text matches ``stop``."""
    end = F.array_position(F.transform(rows, lambda r: F.lower(row_text(r)).rlike(stop)), True)
    return let(end, lambda at: F.when(at > 0, F.slice(rows, F.lit(1), (at - 1).cast("int"))).otherwise(rows))


def stitch(rows: Column) -> Column:
    """struct(head, tail): the text of the first page's rows, which names the parties, and of the last page's, which states the totals."""

    def parts(rs: Column) -> Column:
        last = F.array_max(F.transform(rs, lambda r: F.get(r, F.lit(0))["page"]))
        of = lambda page: full_text(F.filter(rs, lambda r: F.get(r, F.lit(0))["page"] == page))
        return F.struct(of(F.lit(0)).alias("head"), let(last, of).alias("tail"))

    return let(rows, parts)


def below_header(tokens: Column, height: Column, share: float = 0.3) -> Column:
    """Tokens whose centre lies below the header band, the upper ``share`` of a page of some height."""
    return F.filter(tokens, lambda t: t["cy"] > share * height)


def in_region(tokens: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Tokens whose centre lies in a rectangle, borders included."""
    return tokens.where(F.col("cx").between(x1, x2) & F.col("cy").between(y1, y2))


def bottom_share(tokens: DataFrame, doc: str = "doc_id", top: str = "cy", share: float = 0.8) -> DataFrame:
    """Tokens below ``share`` of their document's greatest height."""
    most = F.max(top).over(Window.partitionBy(doc))
    return tokens.withColumn("_most", most).where(F.col(top) > share * F.col("_most")).drop("_most")


def page_breaks(tokens: DataFrame, doc: str = "doc_id", order: str = "idx", drop: float = 1000.0) -> DataFrame:
    """Token rows with the number of page breaks before them."""
    w = Window.partitionBy(doc).orderBy(order)
    falls = F.when((F.lag("cy").over(w) > 0) & (F.col("cy") < F.lag("cy").over(w) - drop), 1).otherwise(0)
    return tokens.withColumn("_break", falls).withColumn("page", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_break")


def near_pairs(tokens: DataFrame, within: float, doc: str = "doc_id") -> DataFrame:
    """Pairs (idx_a < idx_b) of a document's tokens whose centres are less than ``within`` apart.

    Tokens are joined through square cells of that width, so a token meets only those of its own and the neighbouring cells.
    """
    a = tokens.select(doc, F.col("idx").alias("idx_a"), F.col("cx").alias("xa"), F.col("cy").alias("ya"), F.floor(F.col("cx") / within).alias("gx"), F.floor(F.col("cy") / within).alias("gy"))
    offsets = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    b = tokens.select(doc, F.col("idx").alias("idx_b"), F.col("cx").alias("xb"), F.col("cy").alias("yb"), offsets.alias("o"))
    b = b.select(doc, "idx_b", "xb", "yb", (F.floor(F.col("xb") / within) + F.col("o.i")).alias("gx"), (F.floor(F.col("yb") / within) + F.col("o.j")).alias("gy"))
    d2 = (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb"))
    return a.join(b, [doc, "gx", "gy"]).where((F.col("idx_a") < F.col("idx_b")) & (d2 < within * within)).select(doc, "idx_a", "idx_b", F.sqrt(d2).alias("distance"))


def source_token(values: DataFrame, tokens: DataFrame, doc: str = "doc_id", value: str = "value") -> DataFrame:
    """The first token of each document that contains its value, with place and confidence; documents without one keep nulls."""
    hit = values.join(tokens.select(doc, "idx", "text", "conf"), doc).where(F.contains("text", F.col(value)))
    first = hit.groupBy(doc, value).agg(F.min_by(F.struct("idx", "text", "conf"), "idx").alias("t"))
    return values.join(first, [doc, value], "left").select(*values.columns, "t.idx", "t.text", "t.conf")
