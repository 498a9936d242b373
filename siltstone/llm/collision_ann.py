"""Approximate nearest neighbours by collision counting with virtual rehashing.

Every group of candidates keeps `lines` sorted arrays, each the projections on one random direction.  A query opens a
window around its own projection in every array and widens all of them step by step; the arrays serve all widths, so no
width needs an index of its own.  A candidate's collisions are the windows that hold it; from `share` of the arrays on
it is verified by its exact distance.  Widening ends when a candidate as near as the present k-th best would, by the
normal distribution of projected differences, have reached the threshold with probability `sure`.

Every row is indexed; directions are drawn from a seed.  Groups are searched independently and the k best of all stay.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame

from siltstone.llm.blocks import search


def _reach(lines: int, need: int, sure: float) -> float:
    """The window's half width over the distance at which `need` of `lines` collide with probability `sure`."""

    def chance(z: float) -> float:
        p = math.erf(z / math.sqrt(2))
        return sum(math.comb(lines, i) * p**i * (1 - p) ** (lines - i) for i in range(need, lines + 1))

    low, high = 0.0, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chance(mid) < sure else (low, mid)
    return high


class SortedLines:
    """A group's vectors with their projections in sorted arrays."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, lines: int, share: float, sure: float, growth: float, seed: int):
        self.ids, self.matrix = ids, matrix
        self.need = max(1, math.ceil(share * lines))
        self.directions = np.random.default_rng([seed, matrix.shape[1]]).standard_normal((matrix.shape[1], lines))
        self.reach, self.growth = _reach(lines, self.need, sure), growth
        self.scale = float(np.abs(matrix).max(initial=0)) or 1.0
        power = math.frexp(self.scale)[1]
        self.factor = 2.0**-power if abs(power) > 400 else 1.0  # a power of two, where squares would leave the doubles' range
        projected = (matrix / self.scale @ self.directions).T
        order = np.argsort(projected, axis=1).astype(np.int32)
        # the arrays lie in one, each moved beyond the one before, so a window's ends are found in all of them at once
        self.gap = np.arange(lines) * (2 * float(np.abs(projected).max(initial=0)) + 1)
        self.order, self.sorted = order.ravel(), (np.take_along_axis(projected, order, axis=1) + self.gap[:, None]).ravel()
        spread = float(np.median(np.abs(projected - np.median(projected, axis=1, keepdims=True))))
        self.start = spread / 4 or 1e-9

    def __call__(self, query_id: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        at = vector / self.scale @ self.directions + self.gap
        half, count = self.start, np.zeros(n, np.int64)
        first = np.arange(len(at)) * n
        low = high = np.clip(np.searchsorted(self.sorted, at), first, first + n)
        seen = self.ids == query_id
        found, distance = np.zeros(0, np.int64), np.zeros(0)
        while True:
            left = np.clip(np.searchsorted(self.sorted, at - half, "left"), first, first + n)
            right = np.clip(np.searchsorted(self.sorted, at + half, "right"), first, first + n)
            ends = zip(np.r_[left, high].tolist(), np.r_[low, right].tolist(), strict=True)
            count += np.bincount(np.concatenate([self.order[a:b] for a, b in ends]), minlength=n)
            low, high = left, right
            new = np.flatnonzero((count >= self.need) & ~seen)
            if len(new):
                seen[new] = True
                with np.errstate(over="ignore"):
                    away = np.sqrt(((self.matrix[new] * self.factor - vector * self.factor) ** 2).sum(axis=1))
                found, distance = np.r_[found, new], np.r_[distance, away]
                best = np.lexsort((self.ids[found], distance))[:k]
                found, distance = found[best], distance[best]
            far = self.reach * distance[-1] / self.scale / self.factor if len(found) == k else np.inf
            if half >= far or (right - left).min() == n:
                return self.ids[found], distance / self.factor
            half = max(half * self.growth, min(half * self.growth**4, far)) if len(found) == k else half * self.growth


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    lines: int = 64,
    share: float = 0.6,
    sure: float = 0.98,
    growth: float = 1.25,
    seed: int = 7,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Each query's k nearest found by Euclidean distance, ties to smaller ids: query_id, rank, vec_id, score.

    Vectors that are null, empty, zero or hold null or non-finite components, and null ids, take no part; vectors of
    another dimension than the query's are no candidates.  Repeated rows are candidates each; where fewer than k
    candidates exist all of them return.
    """
    return search(vectors, queries, lambda ids, m: SortedLines(ids, m, lines, share, sure, growth, seed), k, False, "double", id_col, vec_col, False)
