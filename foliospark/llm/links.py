"""Similar strings by a pigeonhole segment join, and what links make of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.runtime import cut

_KEYED = pa.schema([("id", pa.int64()), ("s", pa.string()), ("block", pa.string()), ("length", pa.int32()), ("part", pa.int32()), ("piece", pa.string())])
_KEYED_DDL = "id bigint, s string, block string, length int, part int, piece string"


def _cuts(length: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k + 1 segments of a string, as even as can be."""
    edges = [length * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def segments(s: str, most: Callable[[int], int]) -> list[tuple[int, int, str]]:
    """What an inverted index holds of ``s``: (its length, number, text) of its segments."""
    return [(len(s), i, s[p : p + n]) for i, (p, n) in enumerate(_cuts(len(s), most(len(s))))]


def probes(s: str, most: Callable[[int], int], widest: int, shorter_only: bool) -> set[tuple[int, int, str]]:
    """What ``s`` looks up: for each length an indexed string may have, substrings around each segment's place.

    Shifts are bounded by the edits that may lie before the segment and those left for what follows it.
    """
    out = set()
    for length in range(max(1, len(s) - widest), len(s) + 1 if shorter_only else len(s) + widest + 1):
        k, gap = most(min(length, len(s))), len(s) - length
        if abs(gap) > k:
            continue
        for i, (p, n) in enumerate(_cuts(length, most(length))):
            k_index = most(length)
            for start in range(max(0, p - i, p + gap - (k_index - i)), min(len(s) - n, p + i, p + gap + (k_index - i)) + 1):
                out.add((length, i, s[start : start + n]))
    return out


def _keyed(strings: DataFrame, keys: Callable[[str], object]) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, s, block, *k) for i, block, s in zip(*(c.to_pylist() for c in b.columns)) for k in keys(s)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KEYED)], schema=_KEYED)

    return strings.select("id", "block", "s").where("s != ''").mapInArrow(emit, _KEYED_DDL).select("id", "s", F.xxhash64("block", "length", "part", "piece").alias("key"))


def similar_pairs(asking: DataFrame, indexed: DataFrame, most: Callable[[int], int], within: bool = True) -> DataFrame:
    """``a, b``: ids of strings of one block within ``most(length of the shorter)`` edits.

    Both sides have ``id`` bigint, ``block`` and ``s`` string.  Each indexed string is cut into one segment more than the edits allowed, so of two similar
    strings one segment stays whole; asking strings look up their substrings near each segment's place.  Candidates are verified by
    edit distance within a band.  ``most`` must not fall with the length.  ``within`` says that both sides hold the same ids, and drops a = b.
    """
    widest = max(most(n) for n in range(1, 200))
    index = _keyed(indexed, lambda s: segments(s, most)).select(F.col("id").alias("b"), F.col("s").alias("t"), "key")
    asked = _keyed(asking, lambda s: probes(s, most, widest, False)).select(F.col("id").alias("a"), "s", "key")
    limits = F.array(*(F.lit(most(n)) for n in range(0, 200)))
    k = F.element_at(limits, F.least(F.least(F.length("s"), F.length("t")), F.lit(199)) + 1)
    pairs = asked.join(index, "key")
    if within:
        pairs = pairs.where("a != b")
    return pairs.withColumn("d", F.levenshtein("s", "t", widest)).where((F.col("d") >= 0) & (F.col("d") <= k)).select("a", "b").distinct()


def components(edges: DataFrame, vertices: DataFrame, rounds: int | None = None) -> DataFrame:
    """``id, component``: the connected component of every vertex, named by its smallest id.

    Each round takes the smallest label around a vertex, then the label of that label, so rounds grow with the logarithm of a component's
    width, and go on until no label changes; if ``rounds`` are given and don't suffice, that is an error.  Labels and edges stay distributed; only a count
    of changes reaches the driver.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    touched = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component"))
    labels = cut(touched)
    for done in count():
        if done == rounds:
            raise RuntimeError(f"components still grow after {rounds} rounds")
        around = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(around, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("beyond"))
        new = cut(lower.join(jump, "c", "left").select("id", "was", F.least("c", "beyond").alias("component")))
        changed = new.where("component != was").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            break
    return vertices.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def pairs_within(members: DataFrame, member: str, group: str) -> DataFrame:
    """``{member}_a, {member}_b`` of all members of a group, a < b."""
    one = members.select(F.col(group).alias("g"), F.col(member).alias(f"{member}_a")).distinct()
    other = one.withColumnRenamed(f"{member}_a", f"{member}_b")
    return one.join(other, "g").where(F.col(f"{member}_a") < F.col(f"{member}_b")).select(f"{member}_a", f"{member}_b")
