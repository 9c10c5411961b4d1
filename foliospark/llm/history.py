"""Repeats of uploads against everything accepted before, through suffix arrays of batches.

A perceptual hash is a text of four 16-bit symbols, an upload hash one of sixteen.  The texts of what was accepted together are one concatenated text; its suffix
array is kept as the sorted leading 64 bits of every suffix beside the id of the record that it belongs to.  New texts look their substrings up by binary search:

* Of two perceptual hashes within six bits one symbol differs in at most one bit, so each symbol and its one-bit variants are looked up.  What a match, taken on
  over the whole record, covers of it decides: 58 bits of 64 or more.
* A symbol that more than ``DENSE`` suffixes begin with says too little.  Its suffixes stand in the array a second time with each other symbol behind it, and, if
  two symbols are as frequent, a third time: a longer match with up to two flips, then three, is looked up there.  No range that is scanned grows with the history.
* An upload hash is covered whole by one match of sixteen symbols.

The arrays are immutable and merge logarithmically; see ``history_store``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, BITS = 4, 16
#: Suffixes of one beginning beyond which longer matches are looked up instead.
DENSE = 32_768
NONE = np.int64(2**63 - 1)
#: Classes of suffixes: the symbols that lead, in order.  Behind them stand upload hashes and ids.
ORDERS: dict[int, tuple[int, ...]] = {i: o for i, o in enumerate([o for n in (1, 2, 3) for o in permutations(range(WORDS), n)])}
CLASS_OF = {o: i for i, o in ORDERS.items()}
HASH, ID = 100, 101
_CHUNK = 1 << 21


def canonical_hex(value: Column, digits: int) -> Column:
    """``value`` as ``digits`` lower-case hex digits, however it was written; null if it identifies nothing.

    A scheme or 0x prefix, case, blanks and separators don't matter, nor do dropped or added leading zeros.  Empty, all-zero, far too short and
    malformed values identify nothing.
    """
    t = F.regexp_replace(F.lower(value.cast("string")), r"^\s*[0-9a-z_\-]*[g-z][0-9a-z_\-]*[:=]\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\s:_\-{}\"']", ""), "^0x", "")
    t = F.regexp_replace(t, "^0+", "")
    good = t.rlike("^[0-9a-f]{%d,%d}$" % (max(1, digits - 8 if digits > 16 else digits - 6), digits))
    return F.when(good, F.lpad(t, digits, "0"))


def hex_to_long(text: Column) -> Column:
    """16 hex digits as the signed 64-bit number of the same bits."""
    half = lambda at: F.conv(F.substring(text, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def full_order(order: tuple[int, ...]) -> tuple[int, ...]:
    """All four symbols: those of ``order``, then the others from behind the last on, in a ring."""
    last = order[-1]
    return order + tuple(w for w in ((last + i) % WORDS for i in range(1, WORDS)) if w not in order)


def suffix_column(value: Column, order: tuple[int, ...]) -> Column:
    """The symbols of a 64-bit value in the order of a class, as a number that sorts like the text."""
    out = F.lit(0).cast("bigint")
    for at, w in enumerate(full_order(order)):
        symbol = F.shiftrightunsigned(value, BITS * (WORDS - 1 - w)).bitwiseAND(F.lit(0xFFFF))
        out = out.bitwiseOR(F.shiftleft(symbol, BITS * (WORDS - 1 - at)))
    return sortable(out)


def sortable(value: Column) -> Column:
    """Signed numbers in the order of the unsigned ones of the same bits."""
    return value.bitwiseXOR(F.lit(-(2**63)).cast("bigint"))


def reorder(suffix: np.ndarray, had: tuple[int, ...], wanted: tuple[int, ...]) -> np.ndarray:
    """Suffixes of one class as those of another."""
    u = suffix.view(np.uint64) ^ np.uint64(1 << 63)
    out = np.zeros_like(u)
    place = {w: at for at, w in enumerate(full_order(had))}
    for at, w in enumerate(full_order(wanted)):
        out |= ((u >> np.uint64(BITS * (WORDS - 1 - place[w]))) & np.uint64(0xFFFF)) << np.uint64(BITS * (WORDS - 1 - at))
    return (out ^ np.uint64(1 << 63)).view(np.int64)


@lru_cache(maxsize=32)
def flips(most: int, place: int) -> np.ndarray:
    """Masks of at most ``most`` flipped bits of the symbol at ``place``."""
    shift = BITS * (WORDS - 1 - place)
    return np.array([sum(1 << (i + shift) for i in x) for k in range(most + 1) for x in combinations(range(BITS), k)], np.uint64).view(np.int64)


class SuffixArray:
    """The sorted suffixes of one class, in one or more chunks that follow each other; chunks may be mapped files."""

    def __init__(self, chunks: list[tuple[int, int, Callable[[], tuple[np.ndarray, np.ndarray]]]]) -> None:
        self.firsts = np.array([c[0] for c in chunks], np.int64)
        self.starts = np.concatenate([[0], np.cumsum([c[1] for c in chunks])]).astype(np.int64)
        self._load = [c[2] for c in chunks]
        self._held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        #: Suffixes compared and positions looked up, for measurements.
        self.compared = self.looked_up = 0

    def chunk(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self._held:
            self._held[i] = self._load[i]()
        return self._held[i]

    def find(self, values: np.ndarray, side: str) -> np.ndarray:
        """Where each of ``values`` belongs among all suffixes."""
        self.looked_up += len(values)
        which = np.maximum(np.searchsorted(self.firsts, values, side=side) - 1, 0)
        out = np.empty(len(values), np.int64)
        for c in np.unique(which):
            rows = np.flatnonzero(which == c)
            out[rows] = self.starts[c] + np.searchsorted(self.chunk(int(c))[0], values[rows], side=side)
        return out

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes and record ids at positions."""
        self.compared += len(at)
        if len(self._load) == 1:
            s, i = self.chunk(0)
            return s[at], i[at]
        which = np.searchsorted(self.starts, at, side="right") - 1
        s, i = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for c in np.unique(which):
            rows = np.flatnonzero(which == c)
            a, b = self.chunk(int(c))
            s[rows], i[rows] = a[at[rows] - self.starts[c]], b[at[rows] - self.starts[c]]
        return s, i


def lower_by_coverage(array: SuffixArray, asked: np.ndarray, before: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int, best: np.ndarray) -> None:
    """Lowers ``best`` of ``rows`` to the smallest id below ``before`` among the records of their ranges that are covered but for ``most`` bits, in bounded pieces."""
    sizes = hi - lo
    ends = np.cumsum(sizes)
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _CHUNK, side="right")))
        n = sizes[a:b]
        who = np.repeat(np.arange(a, b), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[a:b], n)
        s, ids = array.take(at)
        good = (np.bitwise_count((s ^ asked[who]).view(np.uint64)) <= most) & (ids < before[who])
        np.minimum.at(best, rows[who[good]], ids[good])
        a = b


def earliest(arrays: dict[int, SuffixArray], order: tuple[int, ...], read: np.ndarray, true: np.ndarray, before: np.ndarray, most: int, dense: int = DENSE) -> np.ndarray:
    """For each query, a suffix of class ``order``, the smallest id below ``before`` of a record within ``most`` bits that begins as the query does.

    ``read`` is what is looked up, its last leading symbol with an equal share of ``most`` flips over the symbols that were not yet matched; ``true``
    is the text that the whole record is compared with.  Beginnings of more than ``dense`` suffixes are read on with each other symbol.
    """
    best = np.full(len(read), NONE)
    array = arrays.get(CLASS_OF[order])
    if array is None:
        return best
    depth = len(order)
    tail = np.int64((1 << (BITS * (WORDS - depth))) - 1)
    masks = flips(most // (WORDS + 1 - depth), depth - 1)
    step = max(1, _CHUNK // len(masks))
    for a in range(0, len(read), step):
        part = read[a : a + step]
        low = (part[:, None] ^ masks[None, :]).ravel() & ~tail
        in_order = np.argsort(low, kind="stable")
        lo, hi = np.empty_like(low), np.empty_like(low)
        lo[in_order], hi[in_order] = array.find(low[in_order], "left"), array.find(low[in_order] | tail, "right")
        who = np.repeat(np.arange(a, a + len(part)), len(masks))
        wide = (hi - lo > dense) & (depth < WORDS - 1)
        some = np.flatnonzero((hi > lo) & ~wide)
        lower_by_coverage(array, true[who[some]], before[who[some]], who[some], lo[some], hi[some], most, best)
        far = np.flatnonzero(wide)
        for w in sorted(set(range(WORDS)) - set(order)) if len(far) else ():
            longer, rows = (*order, w), who[far]
            flipped = read[rows] ^ np.tile(masks, len(part))[far]
            deeper = earliest(arrays, longer, reorder(flipped, order, longer), reorder(true[rows], order, longer), before[rows], most, dense)
            np.minimum.at(best, rows, deeper)
    return best


def upload_marks(uploads: DataFrame) -> DataFrame:
    """``upload_id, kind, mark``: the canonical hashes of every upload, one row each; null where they identify nothing.

    Rows without an id are left out.  Of rows that share an id the one of the smallest batch counts, a null batch as the smallest.
    """
    rows = uploads.where("upload_id is not null").select(
        F.col("upload_id").cast("bigint"), F.coalesce(F.col("batch_id").cast("int"), F.lit(-1)).alias("batch"),
        canonical_hex(F.col("upload_hash"), 64).alias("h"), canonical_hex(F.col("phash"), 16).alias("p"),
    )
    once = rows.groupBy("upload_id").agg(F.min(F.struct("batch", "h", "p")).alias("r"))
    mark = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("mark"))
    return once.select("upload_id", F.explode(F.array(mark(HASH, "r.h"), mark(0, "r.p"))).alias("m")).select("upload_id", "m.*")
