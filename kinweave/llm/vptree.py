"""Vantage-point trees over unit vectors, with relaxed triangle-inequality pruning.

A tree is complete: every inner node holds a vantage point ``p`` and the median distance
``mu`` of its points to ``p``; points nearer than ``mu`` go left, the others right.  A query
with search radius ``r`` may skip the far side if ``|d(q, p) - mu| > r``, by the triangle
inequality.  In many dimensions that hardly ever happens, so the bound is relaxed by a
``factor``: the far side is skipped if ``|d(q, p) - mu| > r / factor``.  ``factor=1`` gives
exact search, a larger one visits fewer leaves.
"""

from __future__ import annotations

import numpy as np

#: Vantage points tried for each node; the one with the widest spread of distances wins.
VANTAGE_TRIALS = 12
#: Points on which a trial's spread is measured.
SPREAD_SAMPLE = 400


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows of unit ``vectors`` and the rows of ``pivots`` beside them."""
    dots = np.einsum("ij,ij->i", vectors, pivots)
    return np.sqrt(np.maximum(2.0 - 2.0 * dots, 0.0))


class VPTree:
    """A complete tree of ``depth`` levels; its leaves are numbered from 0 to ``2**depth - 1``."""

    def __init__(self, depth: int, pivots: np.ndarray, medians: np.ndarray):
        self.depth, self.pivots, self.medians = depth, pivots, medians

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    @classmethod
    def build(cls, points: np.ndarray, leaf_size: int, seed: int = 0, max_depth: int = 16) -> VPTree:
        """Splits ``points`` at medians until a leaf holds about ``leaf_size`` of them."""
        depth = 0
        while depth < max_depth and len(points) > leaf_size << depth:
            depth += 1
        inner, dim = (1 << depth) - 1, points.shape[1] if points.ndim == 2 else 0
        pivots, medians = np.zeros((inner, dim), dtype=np.float32), np.zeros(inner, dtype=np.float32)
        rng = np.random.default_rng(seed)
        members = {0: np.arange(len(points))}
        for node in range(inner):
            own = members.pop(node)
            if len(own) == 0:
                members[2 * node + 1] = members[2 * node + 2] = own
                continue
            trials = own[rng.integers(0, len(own), VANTAGE_TRIALS)]
            seen = points[own if len(own) <= SPREAD_SAMPLE else own[rng.integers(0, len(own), SPREAD_SAMPLE)]]
            spread = np.sqrt(np.maximum(2.0 - 2.0 * seen @ points[trials].T, 0.0)).std(axis=0)
            pivots[node] = points[trials[int(spread.argmax())]]
            d = np.sqrt(np.maximum(2.0 - 2.0 * points[own] @ pivots[node], 0.0))
            medians[node] = np.median(d)
            near = d <= medians[node]
            members[2 * node + 1], members[2 * node + 2] = own[near], own[~near]
        return cls(depth, pivots, medians)

    def route(self, vectors: np.ndarray, margin: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The leaves that each vector must visit: row numbers, leaves, and whether the leaf is the row's own.

        ``margin`` is the search radius divided by the relaxing factor, for all rows or one for each.
        """
        n = len(vectors)
        row, node, home = np.arange(n), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        margin = np.broadcast_to(np.asarray(margin, dtype=np.float32), (n,))
        for _ in range(self.depth):
            gap = np.empty(len(row), dtype=np.float32)
            for at in range(0, len(row), 1 << 15):  # bounds the memory of gathered pivots
                part = slice(at, at + (1 << 15))
                gap[part] = distances(vectors[row[part]], self.pivots[node[part]]) - self.medians[node[part]]
            far = gap > 0
            both = np.abs(gap) <= margin[row] if margin.any() else np.zeros(len(row), dtype=bool)
            node, other = 2 * node + 1 + far, (2 * node + 2 - far)[both]
            row, node, home = np.concatenate([row, row[both]]), np.concatenate([node, other]), np.concatenate([home, np.zeros(len(other), dtype=bool)])
        return row, node - ((1 << self.depth) - 1), home


def _close_pairs(queries: np.ndarray, points: np.ndarray, q: np.ndarray, ql: np.ndarray, p: np.ndarray, pl: np.ndarray, least: float, out: list) -> None:
    """Pairs of at least ``least`` cosine among the queries and points of each leaf, by one product a leaf."""
    q, ql = (x[np.argsort(ql, kind="stable")] for x in (q, ql))
    if not len(q):
        return
    order = np.argsort(pl, kind="stable")
    p, pl = p[order], pl[order]
    cuts = np.flatnonzero(np.diff(ql)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(ql)]):
        lo, hi = np.searchsorted(pl, ql[a]), np.searchsorted(pl, ql[a], side="right")
        if lo == hi:
            continue
        block = points[p[lo:hi]].T
        for at in range(a, b, 2048):
            rows = q[at : min(at + 2048, b)]
            cos = queries[rows] @ block
            hit = np.flatnonzero(cos >= least)
            if len(hit):
                i, j = np.divmod(hit, cos.shape[1])
                out.append((rows[i], p[lo + j], cos.ravel()[hit]))


def _best(parts: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best partners of each query, ties by the smaller point."""
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    q, p, c = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((p, -c, q))
    q, p, c = q[order], p[order], c[order]
    start = np.r_[True, q[1:] != q[:-1]]
    rank = np.arange(len(q)) - np.flatnonzero(start)[np.cumsum(start) - 1]
    keep = rank < k
    return q[keep], p[keep], c[keep]


def shard_search(vectors: np.ndarray, home: np.ndarray, k: int, least: float, factor: float, leaf_size: int = 256, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar home vectors of each vector of a shard: rows, partners and cosines of at least ``least``.

    A tree is built on the home vectors.  Each row first searches its own leaf; the distance of
    its k-th partner there, or else the radius of ``least``, bounds the second, pruned search.
    """
    points = np.flatnonzero(home)
    tree = VPTree.build(vectors[points], leaf_size, seed)
    row, leaf, _ = tree.route(vectors)
    own = np.empty(len(vectors), dtype=np.int64)
    own[row] = leaf
    found: list = []
    _close_pairs(vectors, vectors, np.arange(len(vectors)), own, points, own[points], least, found)
    found = [tuple(x[a != b] for x in (a, b, c)) for a, b, c in found]
    if tree.depth == 0:
        return _best(found, k)
    q, p, c = _best(found, k)
    radius = np.full(len(vectors), np.sqrt(2.0 - 2.0 * least), dtype=np.float32)
    many, count = np.unique(q, return_counts=True)
    full = np.isin(q, many[count >= k])
    if full.any():
        worst = np.full(len(vectors), np.inf, dtype=np.float32)
        np.minimum.at(worst, q[full], c[full])
        radius = np.where(np.isfinite(worst), np.minimum(radius, np.sqrt(np.maximum(2.0 - 2.0 * worst, 0.0))), radius)
    row, leaf, at_home = tree.route(vectors, radius / factor)
    other: list = [(q, p, c)]
    _close_pairs(vectors, vectors, row[~at_home], leaf[~at_home], points, own[points], least, other)
    return _best(other, k)
