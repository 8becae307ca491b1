"""Slab sweeps over many groups of polygons at once, in columns of edges.

A group is a pair whose overlap is sought, a set whose union is sought, or one polygon alone. Its plane is cut at every
vertex and every crossing of its edges; a slab holds the edges that span it, found by the ranks of their ends and not by
tests; in order of height each edge takes its polygon in or out. A stretch counts where enough polygons are in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Pairs of edges, and edges in slabs, that one pass holds.
WORK = 2_000_000


@dataclass
class Edges:
    """Edges from a to b of the polygons ``owner`` (numbers of their own over all groups) in ``group`` (0, 1, ... in order)."""

    a: np.ndarray
    b: np.ndarray
    owner: np.ndarray
    group: np.ndarray

    def take(self, which: np.ndarray | slice) -> Edges:
        return Edges(self.a[which], self.b[which], self.owner[which], self.group[which])


@dataclass
class Spans:
    """Stretches of slabs: the slab's sides, heights at its middle, slopes of the edges below and above."""

    group: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray
    below: np.ndarray
    above: np.ndarray

    def corners(self) -> np.ndarray:
        """Each as a closed trapezoid, (n, 5, 2)."""
        half = (self.right - self.left) / 2
        ys = [self.low - self.below * half, self.low + self.below * half, self.high + self.above * half, self.high - self.above * half]
        ring = np.stack([np.stack([x, y], axis=1) for x, y in zip((self.left, self.right, self.right, self.left), ys)], axis=1)
        return np.concatenate([ring, ring[:, :1]], axis=1)


def areas(edges: Edges, need: int | np.ndarray, groups: int, reach: np.ndarray | None = None) -> np.ndarray:
    """Area of each group where ``need`` (of each, or of all) polygons or more are in."""
    out = np.zeros(groups)
    for s in spans(edges, need, groups, reach):
        out += np.bincount(s.group, (s.right - s.left) * (s.high - s.low), groups)
    return out


def spans(edges: Edges, need: int | np.ndarray, groups: int, reach: np.ndarray | None = None) -> Iterator[Spans]:
    """Stretches of all groups, some groups at a time; within ``reach`` (left, right of each group) if given."""
    need = np.broadcast_to(need, groups)
    if reach is not None:
        here = (np.maximum(edges.a[:, 0], edges.b[:, 0]) > reach[edges.group, 0]) & (np.minimum(edges.a[:, 0], edges.b[:, 0]) < reach[edges.group, 1])
        edges = edges.take(here)
    n = np.bincount(edges.group, minlength=groups)
    ends, work = np.cumsum(n), np.cumsum(n.astype(float) ** 2)
    first = 0
    while first < groups:
        last = max(first + 1, int(np.searchsorted(work, (work[first - 1] if first else 0) + WORK, "right")))
        some = edges.take(slice(ends[first - 1] if first else 0, ends[last - 1]))
        if len(some.a):
            yield from _swept(some, need, reach)
        first = last


def _crossings(e: Edges) -> tuple[np.ndarray, np.ndarray]:
    """(x, group) of the proper crossings among the edges of each group."""
    d = e.b - e.a
    low, high = np.minimum(e.a, e.b), np.maximum(e.a, e.b)
    after = np.searchsorted(e.group, e.group, "right") - np.arange(len(e.a)) - 1  # later edges of the same group
    until = np.cumsum(after)
    xs, gs = [np.empty(0)], [np.empty(0, np.int64)]
    first = 0
    while first < len(after):
        base = until[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(until, base + WORK, "right")))
        k = np.repeat(np.arange(first, last), after[first:last])
        m = k + 1 + np.arange(len(k)) - np.repeat(until[first:last] - after[first:last] - base, after[first:last])
        near = (low[k, 0] < high[m, 0]) & (low[m, 0] < high[k, 0]) & (low[k, 1] <= high[m, 1]) & (low[m, 1] <= high[k, 1])
        k, m = k[near], m[near]
        det = d[k, 0] * d[m, 1] - d[k, 1] * d[m, 0]
        w = e.a[m] - e.a[k]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * d[m, 1] - w[:, 1] * d[m, 0]) / det
            u = (w[:, 0] * d[k, 1] - w[:, 1] * d[k, 0]) / det
        met = (det != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        xs.append(e.a[k[met], 0] + t[met] * d[k[met], 0])
        gs.append(e.group[k[met]])
        first = last
    return np.concatenate(xs), np.concatenate(gs)


def _swept(e: Edges, need: np.ndarray, reach: np.ndarray | None) -> Iterator[Spans]:
    cross, cross_group = _crossings(e)
    left, right = np.minimum(e.a[:, 0], e.b[:, 0]), np.maximum(e.a[:, 0], e.b[:, 0])
    if reach is not None:
        lo, hi = reach[e.group].T
        left, right = np.maximum(left, lo), np.minimum(right, hi)
        kept = (cross > reach[cross_group, 0]) & (cross < reach[cross_group, 1])
        cross, cross_group = cross[kept], cross_group[kept]
    x, g = np.r_[left, right, cross], np.r_[e.group, e.group, cross_group]
    order = np.lexsort((x, g))
    x, g = x[order], g[order]
    fresh = np.r_[True, (np.diff(x) != 0) | (np.diff(g) != 0)]
    rank = np.empty(len(x), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    x, begin, end = x[fresh], rank[: len(left)], rank[len(left) : 2 * len(left)]  # an edge spans the slabs begin, ..., end - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (e.b[:, 1] - e.a[:, 1]) / (e.b[:, 0] - e.a[:, 0])
    load = np.cumsum(np.bincount(begin, minlength=len(x)) - np.bincount(end, minlength=len(x)))  # edges in each slab
    until = np.cumsum(load)
    first = 0
    while first < len(x):
        last = max(first + 1, int(np.searchsorted(until, (until[first - 1] if first else 0) + WORK, "right")))
        yield _levels(e, slope, x, np.maximum(begin, first), np.minimum(end, last), need)
        first = last


def _levels(e: Edges, slope: np.ndarray, x: np.ndarray, begin: np.ndarray, end: np.ndarray, need: np.ndarray) -> Spans:
    many = np.maximum(0, end - begin)
    edge = np.repeat(np.arange(len(many)), many)
    slab = np.arange(len(edge)) - np.repeat(np.cumsum(many) - many, many) + begin[edge]
    mid = (x[slab] + x[np.minimum(slab + 1, len(x) - 1)]) / 2
    y = e.a[edge, 1] + (mid - e.a[edge, 0]) * slope[edge]
    order = np.lexsort((y, slab))
    edge, slab, y = edge[order], slab[order], y[order]
    # an edge lets its polygon in if it is that polygon's first, third, ... of the slab
    turn = np.lexsort((np.arange(len(edge)), e.owner[edge], slab))
    at = np.arange(len(turn))
    starts = np.r_[True, (np.diff(slab[turn]) != 0) | (np.diff(e.owner[edge[turn]]) != 0)] if len(turn) else np.empty(0, bool)
    step = np.empty(len(turn), np.int64)
    step[turn] = 1 - 2 * ((at - np.maximum.accumulate(np.where(starts, at, 0))) % 2)
    depth = np.cumsum(step)  # closed polygons leave every slab, so each slab begins at nought
    k = np.flatnonzero((slab[:-1] == slab[1:]) & (depth[:-1] >= need[e.group[edge[:-1]]]) & (y[1:] > y[:-1]))
    return Spans(e.group[edge[k]], x[slab[k]], x[slab[k] + 1], y[k], y[k + 1], slope[edge[k]], slope[edge[k + 1]])
