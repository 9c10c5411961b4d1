"""Clusters of tokens by place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.runtime import spread


def density_labels(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Labels of points linked by steps of at most ``eps``, numbered by first point; lone points are -1.

    Points of one grid cell of diagonal ``eps`` are linked; beyond that only neighbouring cells are compared, and only until they are linked.
    """
    n = len(x)
    if not n:
        return np.zeros(0, int)
    side = eps / np.sqrt(2)
    grid = np.stack([np.floor(x / side), np.floor(y / side)], 1).astype(np.int64)
    cells, own = np.unique(grid, axis=0, return_inverse=True)
    own = own.reshape(-1)
    order = np.argsort(own, kind="stable")
    members = np.split(order, np.cumsum(np.bincount(own, minlength=len(cells)))[:-1])
    at = {tuple(c): i for i, c in enumerate(cells.tolist())}
    parent = list(range(len(cells)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ahead = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0) and (abs(i), abs(j)) != (2, 2)]
    for i, (cx, cy) in enumerate(cells.tolist()):
        for dx, dy in ahead:
            j = at.get((cx + dx, cy + dy))
            if j is None or root(i) == root(j):
                continue
            a, b = members[i], members[j]
            if any(((x[p] - x[b]) ** 2 + (y[p] - y[b]) ** 2 <= eps * eps).any() for p in a):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    group = np.array([root(i) for i in range(len(cells))])[own]
    _, first, again, size = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
    rank = np.full(len(first), -1)
    linked = np.flatnonzero(size > 1)
    rank[linked[np.argsort(first[linked])]] = np.arange(len(linked))
    return rank[again.reshape(-1)]


def cluster_tokens(tokens: DataFrame, eps: float = 200.0, doc: str = "doc_id") -> DataFrame:
    """``doc, idx, label`` of each document's tokens with ``cx`` and ``cy``: 0 for the first cluster, 1 for the next, -1 for lone tokens.

    A document of fewer than two tokens is one cluster.  A task holds one document at a time.
    """

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in _documents(batches, doc):
            x, y = pdf["cx"].to_numpy(), pdf["cy"].to_numpy()
            found = np.concatenate([density_labels(x[a:b], y[a:b], eps) if b - a > 1 else np.zeros(b - a, int) for a, b in bounds])
            yield pd.DataFrame({doc: pdf[doc].to_numpy(), "idx": pdf["idx"].to_numpy(), "label": found})

    placed = tokens.where("cx is not null and cy is not null").select(doc, "idx", "cx", "cy")
    return spread(placed, doc).sortWithinPartitions(doc, "idx").mapInPandas(label, f"{doc} bigint, idx int, label int")


def cluster_labels(cx: Column, cy: Column, eps: float = 200.0) -> Column:
    """Labels, as of ``cluster_tokens``, of the tokens of one row, from arrays of their centres; tokens without a centre are -1."""

    def label(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys):
            a, b = np.array([] if x is None else x, float), np.array([] if y is None else y, float)
            found, placed = np.full(len(a), -1), ~np.isnan(a) & ~np.isnan(b)
            found[placed] = density_labels(a[placed], b[placed], eps) if placed.sum() > 1 else 0
            out.append(found)
        return pd.Series(out)

    return F.pandas_udf(label, "array<int>")(cx, cy)


def _documents(batches: Iterator[pd.DataFrame], doc: str) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Batches of whole documents of a sorted partition, with the rows of each."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        ids = pdf[doc].to_numpy()
        edges = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        last = int(edges[-1]) if len(edges) else 0
        if last:
            yield pdf.iloc[:last], list(zip([0, *edges[:-1].tolist()], edges.tolist()))
        rest = pdf.iloc[last:]
    if rest is not None and len(rest):
        yield rest, [(0, len(rest))]


def best_centers(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of the best ``k`` clusters of numbers by least squares, ascending, found exactly."""
    s = np.sort(x.astype(float))
    n = len(s)
    k = min(k, len(np.unique(s)))
    if not n:
        return s
    c1, c2 = np.concatenate([[0], np.cumsum(s)]), np.concatenate([[0], np.cumsum(s * s)])
    i = np.arange(n)
    cost = lambda a, b: c2[b] - c2[a] - (c1[b] - c1[a]) ** 2 / np.maximum(b - a, 1)
    best, back = cost(np.zeros(n, int), i + 1), np.zeros((k, n), int)
    for m in range(1, k):
        new = np.full(n, np.inf)
        for j in range(m, n):
            a = np.arange(m, j + 1)
            v = best[a - 1] + cost(a, np.full(len(a), j + 1))
            at = int(np.argmin(v))
            new[j], back[m, j] = v[at], a[at]
        best = new
    cuts, j = [], n - 1
    for m in range(k - 1, -1, -1):
        a = back[m, j] if m else 0
        cuts.append((a, j + 1))
        j = a - 1
    return np.array([s[a:b].mean() for a, b in reversed(cuts)])


def column_centers(tokens: DataFrame, most: int = 5, doc: str = "doc_id") -> DataFrame:
    """``doc, column, center``: centres of at most ``most`` columns of each document's token centres."""

    def centers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in _documents(batches, doc):
            ids, x = pdf[doc].to_numpy(), pdf["cx"].to_numpy()
            rows = [(ids[a], i, c) for a, b in bounds for i, c in enumerate(best_centers(x[a:b], most))]
            yield pd.DataFrame(rows, columns=[doc, "column", "center"])

    return spread(tokens.where("cx is not null").select(doc, "cx"), doc).sortWithinPartitions(doc).mapInPandas(centers, f"{doc} bigint, column int, center double")
