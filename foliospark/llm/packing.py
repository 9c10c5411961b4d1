"""Texts packed into windows of fixed capacity by multiway differencing."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.runtime import cut, spread


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window 0..k-1 of each of ``sizes`` after multiway differencing into ``k`` windows.

    Every item begins as a partial partition of its own.  The two partial partitions whose largest and smallest windows differ most
    are merged with opposing imbalances, the largest window of one with the smallest of the other, until one is left.
    Windows that are still empty in both are not stored.
    """
    n = len(sizes)
    if n == 0 or k <= 1:
        return np.zeros(n, np.int64)
    # A partial partition holds its non-smallest windows, ascending, less the smallest of all k.
    loads: list[np.ndarray] = [np.array([s], float) for s in sizes]
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(-float(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        x, y = loads[a], loads[b]
        if len(x) + len(y) <= k:
            both = np.concatenate([x, y])
        else:
            full = np.zeros(k)
            full[k - len(x) :] = x
            full[: len(y)] += y[::-1]
            both = full
        order = np.argsort(both, kind="stable")
        new = both[order]
        if len(both) == k:
            new = new - new[0]
        loads.append(new)
        made.append((a, b, order))
        heapq.heappush(heap, (-float(new[-1]), len(loads) - 1))
        loads[a] = loads[b] = None  # type: ignore[call-overload]
    # Windows are handed down from the last merge to the items.
    out = np.zeros(n, np.int64)
    lengths = [1] * n + [len(order) for _, _, order in made]
    windows = {heap[0][1]: np.arange(lengths[-1])}
    for i in range(len(made) - 1, -1, -1):
        a, b, order = made[i]
        w = windows.pop(n + i)
        place = np.empty_like(w)
        place[order] = w
        la, lb = lengths[a], lengths[b]
        if la + lb <= k:
            wa, wb = place[:la], place[la:]
        else:
            wa, wb = place[k - la :], place[:lb][::-1]
        for child, own in ((a, wa), (b, wb)):
            if child < n:
                out[child] = own[0]
            else:
                windows[child] = own
    return out


def pack(sizes: np.ndarray, capacity: int, full: float = 0.92) -> np.ndarray:
    """A window of each of ``sizes`` (none above ``capacity``) so that no window's sum exceeds ``capacity``.

    Items beside which not even the smallest fits take windows of their own.  The others are differenced into the least number of windows that could
    do.  While some exceed the capacity, those that are ``full`` and don't are kept and the rest is differenced again; if none is, the count rises by one.
    """
    out = np.empty(len(sizes), np.int64)
    positive = sizes[sizes > 0]
    alone = sizes + (positive.min() if len(positive) else 1) > capacity
    used = int(alone.sum())
    out[alone] = np.arange(used)
    rest = np.flatnonzero(~alone)
    k = lower_bound(sizes[rest], capacity) if len(rest) else 0
    while len(rest):
        s = sizes[rest]
        w = difference(s, k) if k < len(s) else np.arange(len(s))
        load = np.bincount(w, weights=s)
        over = load > capacity
        if not over.any():
            out[rest] = used + w
            break
        kept = ~over & (load >= full * capacity)
        if kept.any():
            stays = kept[w]
            out[rest[stays]] = used + (np.cumsum(kept) - 1)[w[stays]]
            used, rest = used + int(kept.sum()), rest[~stays]
            k = lower_bound(sizes[rest], capacity)
        else:
            k += 1
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Windows that any packing needs: by the sum, and with items above half a window alone."""
    s = np.sort(sizes)
    best = max(1, math.ceil(s.sum() / capacity))
    large = s[2 * s > capacity]
    if len(large):
        # What fits beside the large items; the small rest needs windows of its own.
        for cut_at in np.unique(s[2 * s <= capacity])[:: max(1, len(s) // 64)]:
            small = s[(s >= cut_at) & (2 * s <= capacity)].sum()
            mid = large[large <= capacity - cut_at]
            room = len(mid) * capacity - mid.sum()
            best = max(best, len(large) + max(0, math.ceil((small - room) / capacity)))
        best = max(best, len(large))
    return best


def pack_documents(sizes: DataFrame, limits: DataFrame, windows_per_shard: int = 320, items_per_shard: int = 200_000) -> DataFrame:
    """``limit_id, doc_id, part_no, n_tokens, container_id, capacity_tokens``: every document's place for every limit.

    ``sizes`` has ``doc_id`` and ``n_tokens``, ``limits`` has ``limit_id`` and ``capacity_tokens``.  A document above the capacity is cut into whole containers and
    one rest; others are never cut.  Documents are spread by a hash of their id over shards of about ``windows_per_shard``
    windows and at most about ``items_per_shard`` documents, each packed by differencing on its own, so work and memory of a task don't grow with the data.  A document of 0 tokens
    takes no room and goes with the others.  Repeated ids count once, with the largest size; null ids and limits without a positive
    capacity give no row.
    """
    docs = cut(sizes.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("n_tokens", F.lit(0))).cast("bigint").alias("n_tokens")))
    total, n_docs = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    caps = limits.where("capacity_tokens > 0 and limit_id is not null").groupBy("limit_id").agg(F.max("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    # The limits are a handful of parameters, at most one row for each whole capacity.
    options = [F.struct(F.lit(r[0]).cast("int").alias("limit_id"), F.lit(r[1]).cast("bigint").alias("capacity_tokens"), F.lit(max(1, math.ceil(total / (r[1] * windows_per_shard)), math.ceil(n_docs / items_per_shard))).alias("shards")) for r in caps.collect()]
    if not options:
        options = [F.struct(F.lit(0).alias("limit_id"), F.lit(1).cast("bigint").alias("capacity_tokens"), F.lit(1).alias("shards"))]
        docs = docs.where("false")
    each = docs.select("doc_id", "n_tokens", F.explode(F.array(*options)).alias("x")).select("doc_id", "n_tokens", "x.*")
    whole = F.col("n_tokens").cast("bigint") - F.pmod("n_tokens", "capacity_tokens")
    rest = F.pmod(F.col("n_tokens"), F.col("capacity_tokens"))
    each = each.withColumn("rest", F.when(F.col("n_tokens") <= F.col("capacity_tokens"), F.col("n_tokens")).otherwise(rest)).withColumn("shard", F.pmod(F.xxhash64("doc_id", "limit_id"), "shards"))
    full = each.where("n_tokens > capacity_tokens").select(
        "limit_id", "doc_id", F.explode(F.sequence(F.lit(0), ((whole / F.col("capacity_tokens")).cast("int") - 1))).alias("part_no"),
        F.col("capacity_tokens").alias("n_tokens"), "capacity_tokens",
    ).withColumn("container_id", F.concat_ws("-", "limit_id", F.lit("d"), "doc_id", "part_no"))
    items = each.where("n_tokens <= capacity_tokens or rest > 0").select(
        "limit_id", "shard", "capacity_tokens", "doc_id", F.when(F.col("n_tokens") <= F.col("capacity_tokens"), 0).otherwise((whole / F.col("capacity_tokens")).cast("int")).alias("part_no"),
        F.col("rest").alias("n_tokens"),
    )
    schema = "limit_id int, doc_id bigint, part_no int, n_tokens bigint, capacity_tokens bigint, container_id string"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
        w = pack(pdf["n_tokens"].to_numpy(), int(pdf["capacity_tokens"].iloc[0]))
        head = f"{pdf['limit_id'].iloc[0]}-s-{pdf['shard'].iloc[0]}-"
        return pdf.assign(container_id=[head + str(x) for x in w])[["limit_id", "doc_id", "part_no", "n_tokens", "capacity_tokens", "container_id"]]

    packed = spread(items, "limit_id", "shard").groupBy("limit_id", "shard").applyInPandas(fill, schema)
    return full.select("limit_id", "doc_id", "part_no", "n_tokens", "capacity_tokens", "container_id").unionByName(packed)
