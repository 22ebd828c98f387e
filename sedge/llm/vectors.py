"""Vectors as tables: validity, bounded samples and k-means for the two vector indexes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that indexes are fitted on, at most, chosen by a hash of their id.
SAMPLE = 16_384
SEED = 20_240


def valid(table: DataFrame) -> DataFrame:
    """(row, vec_id, v) of the vectors that take part: the most common length, finite, not zero.

    Vectors that are null, zero, of another length, or hold null or non-finite components are left out.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").alias("v")).where(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return rows.where(F.size("v") == (size.d if size else 0))


def sample(rows: DataFrame, most: int = SAMPLE) -> np.ndarray:
    got = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(most).select("v").toArrow().column("v")
    return matrix(got.combine_chunks()) if len(got) else np.zeros((0, 1))


def matrix(column) -> np.ndarray:
    """An Arrow column of equal-length lists as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1), 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, balance: float = 0.0) -> np.ndarray:
    """Centroids by Lloyd's rounds; ``balance`` charges each centroid for the share of rows that it had beyond its due."""
    rng = np.random.default_rng(SEED)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    price = np.zeros(k)
    for _ in range(rounds):
        d = squared(x, c)
        scale = d.min(axis=1).mean()
        own = (d + price).argmin(axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        if len(empty):  # an empty centroid moves beside the fullest
            c[empty] = x[rng.choice(np.flatnonzero(own == n.argmax()), len(empty))]
        price = price + balance * scale * (n * k / len(x) - 1)
        price = price - price.min()
    return c
