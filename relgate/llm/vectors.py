"""Vectors as rows of bytes: which ones take part, and k-means on bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgate.llm.common import hashed_sample


def usable(vector: str) -> Column:
    """Holds for vectors that are neither null, empty nor zero and have finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(values: list) -> np.ndarray:
    return np.array(values, np.float64)


def sample(df: DataFrame, key: str, vector: str, rows: int) -> np.ndarray:
    """At most ``rows`` vectors, in double precision."""
    picked = hashed_sample(df.select(key, vector), key, rows).select(vector).collect()
    return matrix([r[0] for r in picked])


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """At most ``k`` distinct centres by Lloyd's rounds from random distinct rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        moved = sums[counts > 0] / counts[counts > 0, None]
        if moved.shape == centres.shape and np.allclose(moved, centres):
            break
        centres = moved
    return centres


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows, zero at least."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * (x @ y.T), 0)
