"""Exact top-k inner products by columnar branch and bound.

A group of candidates lies in vertical layout: one array for each dimension.  A query accumulates partial products
block of dimensions by block; what a candidate can still gain is at most the product of the norms of both remainders
(Cauchy-Schwarz).  Candidates that cannot reach the k-th best known score go, and the survivors are compacted before
the next block.  Components are integers, floor(scale * x), so scores are exact and ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame

from siltstone.llm.blocks import search

_STEP = 8
_EXACT = 2.0**53
_LONG = (-(2**63), 2**63 - 1)


class VerticalGroup:
    """Integer vectors by dimension, with the norms of what is left after each block."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, scale: float):
        self.ids, self.scale, self.raw = ids, scale, matrix
        with np.errstate(over="ignore"):
            self.whole = np.floor(scale * matrix)
        self.most = float(np.abs(self.whole).max(initial=0))
        self.columns = np.ascontiguousarray(self.whole.T)
        self.left = self._norms(self.columns) if self.most < 2.0**500 else None

    @staticmethod
    def _norms(columns: np.ndarray) -> np.ndarray:
        """Norms of the dimensions from each block on."""
        squares = columns * columns
        return np.sqrt(np.stack([squares[a:].sum(axis=0) for a in range(0, len(columns) + _STEP, _STEP)]))

    def __call__(self, query_id: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            query = np.floor(self.scale * vector)
        if not self.most * float(np.abs(query).max()) * len(query) < _EXACT:
            return self._large(query_id, vector, k)
        rest = self._norms(query[:, None])[:, 0]
        alive = np.flatnonzero(self.ids != query_id)
        total = np.zeros(len(alive))
        least = -np.inf
        for b, a in enumerate(range(0, len(query), _STEP)):
            total += query[a : a + _STEP] @ (self.columns[a : a + _STEP] if len(alive) == len(self.ids) else self.columns[a : a + _STEP][:, alive])
            if len(alive) <= k or a + _STEP >= len(query):
                continue
            if b == 0:  # the best so far, completed, give a first k-th score
                lead = np.argpartition(total, len(total) - k)[-k:]
                least = np.sort(self.whole[alive[lead]] @ query)[0]
            slack = rest[b + 1] * self.left[b + 1][alive]
            least = max(least, np.partition(total - slack, len(total) - k)[-k] - 1)
            keep = total + slack * (1 + 1e-9) + 1 >= least
            if not keep.all():
                alive, total = alive[keep], total[keep]
        order = np.lexsort((self.ids[alive], -total))[:k]
        return self.ids[alive[order]], total[order].astype(np.int64)

    def _large(self, query_id: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Beyond the exact range of doubles: Python's integers; scores outside a long are its ends."""
        query = self._exact(vector)
        scores = [(-sum(a * b for a, b in zip(query, self._exact(v), strict=True)), i) for i, v in zip(self.ids.tolist(), self.raw, strict=True) if i != query_id]
        best = sorted(scores)[:k]
        return np.array([i for _, i in best], np.int64), np.array([min(max(-s, _LONG[0]), _LONG[1]) for s, _ in best], np.int64)

    def _exact(self, vector: np.ndarray) -> list[int]:
        return [math.floor(self.scale * x) if abs(x) < 2.0**60 else int(x) * int(self.scale) for x in vector.tolist()]


def top_products(vectors: DataFrame, queries: Column, k: int = 10, scale: float = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k largest inner products of floor(scale * x) vectors, ties to smaller ids: query_id, rank, vec_id, score.

    Vectors that are null, empty or hold null or non-finite components, and null ids, take no part; vectors of another
    dimension than the query's are no candidates.  Repeated rows are candidates each; fewer than k give fewer rows.
    """
    return search(vectors, queries, lambda ids, m: VerticalGroup(ids, m, scale), k, True, "long", id_col, vec_col, True)
