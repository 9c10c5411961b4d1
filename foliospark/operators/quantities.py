"""Recorded quantities to base units, and unit changes in a source's history.

Two operators live here.  ``normalize_quantities`` reads each line's own statement of number and unit.  ``unit_shifts`` segments
each source's history with an exact penalised changepoint search on log values and names the level shifts that equal a
known factor.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from decimal import ROUND_FLOOR, Decimal, InvalidOperation
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.runtime import cut, spread

# Spellings of the unit codes, lower case without full stops.
SPELLINGS = {
    "mg": ("mg", "mgs", "milligram", "milligrams", "milligramme"),
    "g": ("g", "gm", "gms", "grm", "grms", "gram", "grams", "gramme", "grammes"),
    "kg": ("kg", "kgs", "kgm", "kgms", "kilo", "kilos", "kilogram", "kilograms", "kilogramme"),
    "quintal": ("qtl", "qtls", "quintal", "quintals"),
    "tonne": ("mt", "mts", "tonne", "tonnes", "ton", "tons", "metric ton", "metric tons", "metric tonne", "metric tonnes"),
    "oz": ("oz", "ozs", "ounce", "ounces"),
    "lb": ("lb", "lbs", "pound", "pounds"),
    "ml": ("ml", "mls", "millilitre", "millilitres", "milliliter", "milliliters"),
    "cl": ("cl", "cls", "centilitre", "centilitres", "centiliter", "centiliters"),
    "l": ("l", "lt", "lts", "lit", "lits", "ltr", "ltrs", "litre", "litres", "liter", "liters"),
    "kl": ("kl", "kls", "kilolitre", "kilolitres", "kiloliter", "kiloliters"),
    "gal": ("gal", "gals", "gallon", "gallons"),
    "mm": ("mm", "mms", "millimetre", "millimetres", "millimeter", "millimeters"),
    "cm": ("cm", "cms", "centimetre", "centimetres", "centimeter", "centimeters"),
    "m": ("m", "mtr", "mtrs", "metre", "metres", "meter", "meters", "rmt", "running metre", "running meter"),
    "km": ("km", "kms", "kilometre", "kilometres", "kilometer", "kilometers"),
    "in": ("in", "ins", "inch", "inches", '"', "''"),
    "ft": ("ft", "fts", "foot", "feet", "rft", "running foot", "running feet"),
    "yd": ("yd", "yds", "yard", "yards"),
    "pcs": ("pcs", "pc", "pce", "pces", "piece", "pieces", "nos", "no", "number", "numbers", "each", "ea", "unit", "units"),
    "pair": ("pair", "pairs", "pr", "prs"),
    "dozen": ("doz", "dozs", "dozen", "dozens", "dz", "dzs", "dzn", "dzns"),
    "gross": ("grs", "gross", "gro"),
    "ream": ("ream", "reams", "rm", "rms"),
}
# Words that multiply a counting unit.
MULTIPLIERS = {
    "hundred": 100, "k": 1000, "thousand": 1000, "thou": 1000, "'000": 1000, "000": 1000, "lakh": 100_000, "lakhs": 100_000,
    "lac": 100_000, "lacs": 100_000, "million": 1_000_000, "crore": 10_000_000,
}
# Containers, whose amount is their content.
CONTAINERS = frozenset(
    "bag bags box boxes bx carton cartons ctn ctns drum drums roll rolls coil coils pack packs pkt pkts packet packets bundle bundles bdl bdls sack sacks can cans tin tins jar jars btl btls bottle bottles case cases crate crates tub tubs pail pails barrel barrels bale bales pouch pouches tube tubes".split()
)
# Vulgar fractions.
FRACTIONS = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
# Letters a reader takes for digits.
MISREAD = str.maketrans("IlOoSsBZ|", "110055821")

UNIT_OF = {s: code for code, forms in SPELLINGS.items() for s in forms}
_ALT = "|".join(sorted((re.escape(s).replace(r"\ ", r"\s*") for s in UNIT_OF if s[0].isalpha()), key=len, reverse=True))
_NUM = r"\d[\d.,]*"
#: A size: number, unit.  The unit may be dotted, as in k.g.
_SIZE = re.compile(rf"(?<![\w.,])({_NUM})\s*-?\s*((?:[a-z]\.){{2,3}}|(?:{_ALT})(?![a-z])\.?|\"|'')", re.I)
#: A count of pieces in one container: box of 12, 24's pack.
_COUNT = re.compile(r"(?<![\w.,])(?:(?:box|pack|packet|pkt|carton|ctn|case|set|bag|bundle)\s+of\s+(\d+)(?![\d.,]*\s*[a-z])|(\d+)\s*'s(?![a-z]))", re.I)
#: The unit that the description states for the quantity.
_STATED = re.compile(r"(?:\(\s*(?:qty|quantity)\s+in\s+([^)]+)\)|\[\s*([^\]]+?)\s*\]|measured\s+in\s+(.+?)\s*$|supplied\s+per\s+(.+?)\s*$)", re.I)
_LABELLED = re.compile(r"(?:qty|quantity)\s*(?:\(\s*([^)]*)\)\s*:?|in\s+(.*?))\s*(\S+)\s*$", re.I)
_TOKEN = re.compile(r"\s*([\d.,IlOoSsBZ|]*\d[\d.,IlOoSsBZL|]*|[IOSl|][.,]\d+)")
_FRACTION = re.compile(r"\s*(\d+)\s*/\s*(\d+)")


def plain_number(text: str) -> Decimal | None:
    """A decimal from ``text`` in either notation of comma and full stop, or None."""
    t = text.strip(".,") if text.count(".") + text.count(",") else text
    dot, comma = t.rfind("."), t.rfind(",")
    if dot >= 0 and comma >= 0:
        mark = "." if dot > comma else ","
        t = t.replace("," if mark == "." else ".", "")
        head, _, tail = t.rpartition(mark)
        t = head.replace(mark, "") + "." + tail
    elif comma >= 0:
        head, _, tail = t.rpartition(",")
        t = t.replace(",", "") if len(tail) >= 3 else head.replace(",", "") + "." + tail
    elif t.count(".") > 1:
        t = t.replace(".", "")
    try:
        return Decimal(t)
    except InvalidOperation:
        return None


@lru_cache(maxsize=65536)
def unit_kind(text: str | None) -> tuple[str, str, int] | None:
    """(kind, code, multiplier) of a unit text: kind is ``unit``, ``box`` or ``vague``; None if it is empty."""
    if text is None:
        return None
    t = re.sub(r"\s+", " ", text.strip().lower())
    t = t if t in ('"', "''") else re.sub(r"[.:;()\[\]]", "", t).strip(" -")
    if not t:
        return None
    if t in UNIT_OF:
        return "unit", UNIT_OF[t], 1
    if t in CONTAINERS:
        return "box", t, 1
    head, _, rest = t.partition(" ")
    if head in MULTIPLIERS:
        inner = unit_kind(rest) if rest else ("unit", "pcs", 1)
        return (inner[0], inner[1], inner[2] * MULTIPLIERS[head]) if inner else None
    return "vague", t, 1


@lru_cache(maxsize=65536)
def read_amount(text: str | None) -> list[tuple[Decimal, str]] | None:
    """The (number, unit text) parts of a quantity text, products multiplied out; None without a number.

    ``12 x 250 gms`` gives one part, ``6 kilo 500 grams`` two.  Letters misread for digits are read as digits.
    """
    if not text:
        return None
    t = text.strip()
    for sign, plain in FRACTIONS.items():
        t = t.replace(sign, " " + plain)
    if m := _LABELLED.fullmatch(t):
        n = read_amount(m[3])
        return [(n[0][0], (m[1] or m[2]).strip())] if n and not n[0][1] else None
    parts: list[tuple[Decimal, str]] = []
    times = Decimal(1)
    at = 0
    while at < len(t):
        m = _TOKEN.match(t, at)
        if not m:
            return parts or None
        token, end = m[1], m.end()
        # Letters that begin or are a unit belong to it, as in 8L or 113OZ.
        cut = len(token.rstrip("IlOoSsBZL|"))
        word = token[cut:] + re.match(r"[A-Za-z]*", t[end:])[0]
        if cut < len(token) and (len(word) > len(token) - cut or word.lower() in UNIT_OF):
            token, end = token[:cut], end - (len(token) - cut)
        f = _FRACTION.match(t, m.start(1))
        if f and f.end() > end:
            number, end = (Decimal(f[1]) / Decimal(f[2]) if int(f[2]) else None), f.end()
        else:
            number = plain_number(token.translate(MISREAD))
            if number is not None and (f := _FRACTION.match(t, end)) and int(f[2]):
                number, end = number + Decimal(f[1]) / Decimal(f[2]), f.end()
        if number is None:
            return parts or None
        if x := re.match(r"\s*(?:[x×*])\s*(?=\d)", t[end:], re.I):
            times, at = times * number, end + x.end()
            continue
        # A unit runs to the next number; '000 belongs to the unit.
        u = re.match(r"\s*('000\b)?([^\d]*)", t[end:])
        parts.append((number * times, ((u[1] or "") + " " + u[2]).strip()))
        times, at = Decimal(1), end + u.end()
    return parts or None


def content_of(description: str | None) -> tuple[Decimal, str] | None:
    """Number and unit code of the first size that a description names, else its count of pieces in a pack, or None.

    Notes about grade, item number or cable cores, which no unit follows, are no sizes.
    """
    if not description:
        return None
    for m in _SIZE.finditer(description):
        kind = unit_kind(m[2])
        number = plain_number(m[1])
        if kind and kind[0] == "unit" and number is not None:
            return number, kind[1]
    m = _COUNT.search(description)
    return (Decimal(m[1] or m[2]), "pcs") if m else None


def _amount(value: str | None, unit: str | None, raw: str | None, description: str | None, factors: dict) -> tuple[str, int] | None:
    read, own = read_amount(value), unit_kind(unit)
    if read is None:
        read = read_amount(raw)
    if read is None:
        return None
    if own is None:
        own = unit_kind(read[0][1])
        if own is None and (again := read_amount(raw)) and again[0][1]:
            read, own = again, unit_kind(again[0][1])
        if own is None and description and (m := _STATED.search(description)):
            own = unit_kind(next(x for x in m.groups() if x))
    elif unit_kind(read[0][1]) is None and own[0] == "unit" and (again := read_amount(raw)) and len(again) > 1:
        read = again
    if own is None or own[0] == "vague":
        return None
    first = read[0][0]
    if own[0] == "box":
        inner = content_of(description)
        if inner is None or inner[1] not in factors:
            return None
        base, factor, _ = factors[inner[1]]
        return _half_up(base, first * own[2] * inner[0] * factor)
    if own[1] not in factors:
        return None
    base, factor, _ = factors[own[1]]
    total = first * own[2] * factor
    for number, text in read[1:]:
        more = unit_kind(text)
        if more and more[0] == "unit" and more[1] in factors and factors[more[1]][0] == base:
            total += number * more[2] * factors[more[1]][1]
    return _half_up(base, total)


def _half_up(base: str, total: Decimal) -> tuple[str, int]:
    return base, int((total + Decimal("0.5")).to_integral_value(ROUND_FLOOR))


_OUT = pa.schema([("line_id", pa.int64()), ("base_unit", pa.string()), ("base_qty", pa.int64())])


def unit_factors(unit_codes: DataFrame) -> dict[str, tuple[str, Decimal, str]]:
    """unit_code -> (base unit, factor, dimension).  The table of units is a fixed one of a few dozen rows."""
    rows = unit_codes.select("unit_code", "base_unit", "factor", "dimension").collect()
    return {r[0]: (r[1], Decimal(repr(r[2])), r[3]) for r in rows if r[0] and r[2] is not None}


def normalize_quantities(lines: DataFrame, unit_codes: DataFrame) -> DataFrame:
    """``line_id, base_unit, base_qty`` of every line whose quantity can be stated in a base unit.

    The number comes from ``qty_value``, else from ``qty_raw``; the unit from ``qty_unit``, else from the text of the quantity, else from
    what ``description`` states for it.  Containers count as their number times the content named in ``description``.
    Rows with no number, no unit, a unit that fixes no amount, an unknown unit or an amount beyond 63 bits give no row, as do
    null keys.  A repeated ``line_id`` gives one row; of rows that disagree the smallest (unit, amount) stays.
    Other columns are ignored.
    """
    factors = unit_factors(unit_codes)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for line, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                found = _amount(*texts, factors)
                if found and found[1] < 2**63:
                    out.append((line, *found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    src = lines.where("line_id is not null").select(F.col("line_id").cast("bigint"), *(F.col(c).cast("string") for c in ("qty_value", "qty_unit", "qty_raw", "description")))
    parsed = src.mapInArrow(parse, "line_id bigint, base_unit string, base_qty bigint")
    return parsed.groupBy("line_id").agg(F.min(F.struct("base_unit", "base_qty")).alias("a")).select("line_id", "a.base_unit", "a.base_qty")


def recorded_number(value: str | None, raw: str | None, factors: dict) -> float | None:
    """The number that a line records, from ``value``, else from ``raw``; further parts are added in the unit of the first, as 6 kilo 500 grams."""
    read = read_amount(value)
    if read is None:
        read = read_amount(raw)
    if read is None:
        return None
    total, own = read[0][0], unit_kind(read[0][1])
    for number, text in read[1:]:
        more = unit_kind(text)
        if own and more and own[0] == more[0] == "unit" and own[1] in factors and more[1] in factors and factors[own[1]][0] == factors[more[1]][0]:
            total += number * more[2] * factors[more[1]][1] / (own[2] * factors[own[1]][1])
    return float(total)


def recorded_history(lines: DataFrame, factors: dict) -> DataFrame:
    """``source, at, value`` of lines with ``source, at, qty_value, qty_raw``: the number that each records, null without one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = [recorded_number(v, r, factors) for v, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(numbers, pa.float64())], ["source", "at", "value"])

    src = lines.select(F.col("source").cast("string"), F.col("at").cast("bigint"), F.col("qty_value").cast("string"), F.col("qty_raw").cast("string"))
    return src.mapInArrow(read, "source string, at bigint, value double")


def penalised_segments(values: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments of the exact penalised least-squares segmentation of ``values``.

    Minimises the squared deviations from segment means plus ``penalty`` a segment, by dynamic programming over the last
    change with candidates pruned once they can't be optimal again, so the optimum is the full search's.  Ties go to fewer segments.
    """
    n = len(values)
    if n == 0:
        return []
    s1 = np.concatenate([[0.0], np.cumsum(values)])
    s2 = np.concatenate([[0.0], np.cumsum(values * values)])
    best = np.empty(n + 1)
    best[0] = -penalty
    last = np.zeros(n + 1, np.int64)
    open_at = np.array([0])
    for t in range(1, n + 1):
        total = s1[t] - s1[open_at]
        bound = best[open_at] + (s2[t] - s2[open_at]) - total * total / (t - open_at)
        i = int(np.argmin(bound))
        best[t], last[t] = bound[i] + penalty, open_at[i]
        open_at = np.append(open_at[bound <= best[t] + 1e-9], t)
    starts, t = [], n
    while t > 0:
        t = int(last[t])
        starts.append(t)
    return starts[::-1]


SHIFT_SCHEMA = "source string, segment int, first_at bigint, last_at bigint, n bigint, level double, factor double, unit_change boolean"


class Segmenter:
    """The exact penalised segmentation of one source's values, given one by one in order.

    The dynamic programme keeps, for each level that the running segment may have, the start that is best for it; a start that is best for no
    level never is again.  A start is [rows, mean, cost, chain]: cost is that of all rows so far with the mean as level, chain the
    segments before it, each (chain, first, last, rows, mean).  Memory holds the starts still open and segments that not all of them share.
    """

    def __init__(self, penalty: float) -> None:
        self.penalty = penalty
        self.starts: list[list] = [[0, 0.0, 0.0, None, 0]]
        self.pieces: list[tuple[float, float, list]] = [(-np.inf, np.inf, self.starts[0])]
        self.chain: tuple | None = None
        self.rows, self.look = 0, 4096

    def add(self, at: int, x: float) -> None:
        best = None
        for c in self.starts:
            n = c[0] + 1
            if n == 1:
                c[4] = at
            d = x - c[1]
            c[2] += d * d * c[0] / n
            c[1] += d / n
            c[0] = n
            if best is None or c[2] < best[2]:
                best = c
        self.chain = (best[3], best[4], at, best[0], best[1])
        worth = best[2] + self.penalty
        fresh = [0, 0.0, worth, self.chain, 0]
        pieces: list[tuple[float, float, list]] = []
        edge = -np.inf
        for lo, hi, c in self.pieces:
            room = worth - c[2]
            if room < 0:
                continue
            half = math.sqrt(room / c[0])
            lo, hi = max(lo, c[1] - half), min(hi, c[1] + half)
            if lo >= hi:
                continue
            if lo > edge:
                pieces.append((edge, lo, fresh))
            pieces.append((lo, hi, c))
            edge = hi
        if edge < np.inf:
            pieces.append((edge, np.inf, fresh))
        self.pieces = pieces
        self.starts = list({id(c): c for _, _, c in pieces}.values())
        self.starts.sort(key=lambda c: -c[0])
        self.rows += 1

    def settled(self) -> list[tuple[int, int, int, float]]:
        """The segments (first, last, rows, mean) that all open starts share and that were not yet given."""
        if self.rows < self.look:
            return []
        chains = [_links(c[3]) for c in self.starts]
        shared = 0
        while all(len(x) > shared and x[shared] is chains[0][shared] for x in chains):
            shared += 1
        # Links lead back: what is settled is cut off by building the rest anew, each link once.
        made: dict[int, tuple] = {}
        for c, links in zip(self.starts, chains):
            new = None
            for link in links[shared:]:
                new = made.setdefault(id(link), (new, *link[1:]))
            c[3] = new
        self.chain = made.get(id(self.chain))
        self.rows, self.look = 0, max(4096, 4 * max(map(len, chains)) - 4 * shared)
        return [link[1:] for link in chains[0][:shared]]

    def rest(self) -> list[tuple[int, int, int, float]]:
        """The segments not yet given, at the end of the history."""
        return [link[1:] for link in _links(self.chain)]


def _links(chain: tuple | None) -> list[tuple]:
    out = []
    while chain is not None:
        out.append(chain)
        chain = chain[0]
    return out[::-1]


def unit_shifts(history: DataFrame, factors: list[float], penalty: float = 12.0, tolerance: float = 0.35, block: int = 4096) -> DataFrame:
    """Segments of each source's history and the unit changes among them.

    ``history`` has ``source`` string, ``at`` bigint and ``value`` double; others are ignored.  Rows with a null, a non-positive or a
    non-finite value are left out; rows that tie in ``at`` are taken in order of value.  The log values of a source are
    segmented exactly, over its whole history.  A source's base is the mean level of the segments about the level that holds most of its rows,
    all within ``tolerance`` of it to an eighth.  A segment whose level departs from the base by the log of one of ``factors`` or its
    inverse, within ``tolerance``, is a unit change: ``value * factor`` reverses it.  A source is read in order by one task that holds
    ``block`` rows and the state of its search at a time, so it may be of any length; no row is left out.
    """
    rows = history.where("source is not null and at is not null and value > 0 and value < double('infinity')").select(
        F.col("source").cast("string"), F.col("at").cast("bigint"), F.col("value").cast("double")
    )
    ordered = spread(rows, "source").sortWithinPartitions("source", "at", "value")

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        source, search = None, None
        for pdf in _runs(batches, block):
            if search is None or pdf["source"].iloc[0] != source:
                if search is not None:
                    held += [(source, *x) for x in search.rest()]
                source, search = pdf["source"].iloc[0], Segmenter(penalty)
            for at, x in zip(pdf["at"].tolist(), np.log(pdf["value"].to_numpy()).tolist()):
                search.add(at, x)
            held += [(source, *x) for x in search.settled()]
            if len(held) >= 4096:
                yield pd.DataFrame(held, columns=["source", "first_at", "last_at", "n", "level"])
                held = []
        if search is not None:
            held += [(source, *x) for x in search.rest()]
        if held:
            yield pd.DataFrame(held, columns=["source", "first_at", "last_at", "n", "level"])

    # The segments are used twice, and the search is not to run twice.
    found = cut(ordered.mapInPandas(segment, "source string, first_at bigint, last_at bigint, n bigint, level double"))
    own = Window.partitionBy("source")
    # Rows by steps of an eighth of the tolerance, and about each step those within the tolerance; a source has few steps however many segments.
    steps = found.groupBy("source", F.floor(F.col("level") * 8 / tolerance).alias("step")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("level")).alias("total"))
    about = own.orderBy("step").rangeBetween(-8, 8)
    near_by = steps.select("source", "step", "n", F.sum("n").over(about).alias("rows"), F.sum("total").over(about).alias("total"))
    base = near_by.groupBy("source").agg(F.max_by(F.col("total") / F.col("rows"), F.struct("rows", "n", -F.col("step"))).alias("_base"))
    logs = [float(np.log(f)) for f in factors if f > 0 and f != 1] or [float("inf")]
    gaps = F.array(*(F.struct(F.abs(F.col("level") - F.col("_base") - F.lit(s * g)).alias("d"), F.lit(float(np.exp(-s * g))).alias("f")) for g in logs for s in (1.0, -1.0)))
    near = F.array_min(gaps)
    out = found.join(base, "source").withColumn("_near", near).withColumn("segment", F.row_number().over(own.orderBy("first_at", "last_at")) - 1)
    change = (F.col("_near.d") <= tolerance) & (F.abs(F.col("level") - F.col("_base")) > tolerance)
    return out.select(
        "source", F.col("segment").cast("int"), "first_at", "last_at", "n", "level",
        F.when(change, F.col("_near.f")).otherwise(1.0).alias("factor"), change.alias("unit_change"),
    )


def _runs(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """The rows of each source of a sorted partition, in runs of at most ``block``."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        edges = np.flatnonzero(pdf["source"].to_numpy()[1:] != pdf["source"].to_numpy()[:-1]) + 1
        bounds = [0, *edges.tolist(), len(pdf)]
        for a, b in zip(bounds[:-2], bounds[1:-1]):
            for i in range(a, b, block):
                yield pdf.iloc[i : min(i + block, b)]
        a = bounds[-2]
        while len(pdf) - a > block:
            yield pdf.iloc[a : a + block]
            a += block
        rest = pdf.iloc[a:]
    if rest is not None and len(rest):
        yield rest
