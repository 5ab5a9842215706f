"""Fewer dimensions from a fuzzy neighbour graph: an edge table, and its leading eigenvectors by filtered power iteration.

The exact nearest neighbours of each row are weighted so that every row has the same effective number of them; both
directions of a pair are joined as probabilities. The leading eigenvectors of the graph's normalised matrix are found by
multiplying a few columns with it over and over: each product is a join of the edges with the columns and a sum per row.
The products are those of a Chebyshev polynomial by its roots, which damps all below a cut; only the products of columns
with each other, a few numbers, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.neighbours import nearest
from quillspark.sources.io import drop_kept, kept

#: Columns beyond those asked for, which make the others settle sooner.
SPARE = 3
#: Products in one polynomial, and how often it is applied.
DEGREE, ROUNDS = 6, 4
#: Eigenvalues up to this are damped.
CUT = 0.85


def memberships(near: DataFrame, k: int) -> DataFrame:
    """u, v, a from query_id, key, distance: exp(-(distance - least) / scale), the scale such that a row's sum is log2(k)."""
    rows = near.groupBy(F.col("query_id").alias("u")).agg(F.sort_array(F.collect_list(F.struct("distance", F.col("key").alias("v")))).alias("near"))  # k of each row

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["near"].map(len).to_numpy()
            d = np.full((len(batch), sizes.max(initial=1)), np.inf)
            for i, pairs in enumerate(batch["near"]):
                d[i, : len(pairs)] = [p["distance"] for p in pairs]
            least = np.where(d > 0, d, np.inf).min(1)
            over = np.maximum(d - np.where(np.isfinite(least), least, 0)[:, None], 0)
            want = np.minimum(np.log2(max(k, 2)), sizes - 1e-3)  # fewer neighbours cannot sum to more
            low, high = np.zeros(len(batch)), np.full(len(batch), np.inf)
            scale = np.ones(len(batch))
            for _ in range(64):
                less = np.exp(-over / scale[:, None]).sum(1) < want
                low, high = np.where(less, scale, low), np.where(less, high, scale)
                scale = np.where(np.isinf(high), scale * 2, (low + high) / 2)
            mean = np.where(np.isfinite(d), d, 0).sum(1) / np.maximum(sizes, 1)
            weight = np.exp(-over / np.maximum(np.maximum(scale, 1e-3 * mean), 1e-12)[:, None])
            at = np.repeat(np.arange(len(batch)), sizes)
            inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pd.DataFrame({"u": batch["u"].to_numpy()[at], "v": [p["v"] for pairs in batch["near"] for p in pairs], "a": weight[at, inside]})

    return rows.mapInPandas(weigh, "u long, v long, a double")


def fuzzy_graph(near: DataFrame, k: int) -> DataFrame:
    """u, v, w (u < v): the probability that at least one of the two directions holds."""
    directed = memberships(near, k).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "a")
    both = directed.groupBy("u", "v").agg(F.sum("a").alias("s"), F.when(F.count(F.lit(1)) > 1, F.min("a") * F.max("a")).otherwise(0.0).alias("p"))
    return both.select("u", "v", (F.col("s") - F.col("p")).alias("w"))


def _normalised(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, a, own in both directions: weights over the roots of both degrees, and the diagonal; u, degree)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    degree = kept(both.groupBy("u").agg(F.sum("w").alias("degree")), "degrees")
    other = degree.select(F.col("u").alias("v"), F.col("degree").alias("degree_v"))
    inside = both.join(degree, "u").join(other, "v").select("u", "v", (F.col("w") / F.sqrt(F.col("degree") * F.col("degree_v"))).alias("a"), F.lit(0.0).alias("own"))
    return kept(inside.unionByName(degree.select("u", F.col("u").alias("v"), F.lit(0.0).alias("a"), F.lit(1.0).alias("own"))), "matrix"), degree


def _times(matrix: DataFrame, frame: DataFrame, columns: list[str], out: list[str], root: float = 0.0) -> DataFrame:
    """u and the columns of (matrix - root) x frame, over 1 - root."""
    met = matrix.join(frame.select(F.col("u").alias("v"), *columns), "v")
    weight = (F.col("a") - root * F.col("own")) / (1 - root)
    return met.groupBy("u").agg(*(F.sum(weight * F.col(c)).alias(o) for c, o in zip(columns, out)))


def _products(frame: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    row = frame.agg(*(F.sum(F.col(a) * F.col(b)) for a in left for b in right)).first()
    return np.array([0.0 if x is None else x for x in row]).reshape(len(left), len(right))


def _combined(columns: list[str], by: np.ndarray) -> list[Column]:
    """Columns times a small matrix."""
    return [sum((F.col(c) * float(by[i, j]) for i, c in enumerate(columns)), F.lit(0.0)) for j in range(by.shape[1])]


def _independent(products: np.ndarray) -> np.ndarray:
    """A matrix that makes columns with these products orthonormal; directions that have vanished are left out."""
    values, vectors = np.linalg.eigh(products)
    good = values > max(values.max(initial=0.0), 1e-300) * 1e-12
    return vectors[:, good] / np.sqrt(values[good])


def leading_vectors(edges: DataFrame, count: int, rounds: int = ROUNDS, degree: int = DEGREE, cut: float = CUT) -> tuple[DataFrame, np.ndarray]:
    """(u, degree, x0..: leading eigenvectors of the normalised matrix of edges (u, v, w), the trivial one first; their eigenvalues)."""
    matrix, degrees = _normalised(edges)
    width = count + SPARE
    names = [f"x{i}" for i in range(width)]
    start = [(F.xxhash64("u", F.lit(i)) / float(1 << 63) * F.sqrt("degree")).alias(n) for i, n in enumerate(names[1:], 1)]
    now = kept(degrees.select("u", F.sqrt("degree").alias("x0"), *start), "columns")
    roots = [(cut - 1) / 2 + (cut + 1) / 2 * float(np.cos(np.pi * (i + 0.5) / degree)) for i in range(degree)]
    for _ in range(rounds):
        basis = _independent(_products(now, names, names))
        old, names = names, names[: basis.shape[1]]
        last = now.select("u", *(c.alias(n) for c, n in zip(_combined(old, basis), names)))
        for root in roots:
            last = _times(matrix, last, names, names, root)
        now = kept(last, "columns")
    basis = _independent(_products(now, names, names))
    size = basis.shape[1]
    pure = [f"q{i}" for i in range(size)]
    orthonormal = now.select("u", *(c.alias(n) for c, n in zip(_combined(names, basis), pure)))
    met = kept(_times(matrix, orthonormal, pure, [f"{n}_a" for n in pure]).join(orthonormal, "u"), "columns")
    image = _products(met, pure, [f"{n}_a" for n in pure])
    values, vectors = np.linalg.eigh((image + image.T) / 2)
    order = np.argsort(-values)[:count]
    out = met.select("u", *(c.alias(f"x{i}") for i, c in enumerate(_combined(pure, vectors[:, order]))))
    return out.join(degrees, "u"), values[order]


def graph_layout(frame: DataFrame, components: int = 5, n_neighbors: int = 15, metric: str = "cosine", key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """Adds reduced: coordinates of each row in the layout of its neighbour graph, null for rows without a usable vector.

    A coordinate is an eigenvector over the root of the degree, scaled to unit variance, its largest entry positive.
    Where there are fewer independent directions than components, the others are 0.
    """
    near = kept(nearest(frame, frame, n_neighbors, key, vector, metric).withColumnRenamed(key, "key"), "near")
    value = near if metric == "euclidean" else near.withColumn("distance", F.greatest(F.lit(0.0), 1 - F.col("similarity")))
    edges = kept(fuzzy_graph(value.select("query_id", "key", "distance"), n_neighbors), "graph")
    found, values = leading_vectors(edges, components + 1)
    names = [f"x{i}" for i in range(1, len(values))]
    flat = kept(found.select("u", *((F.col(n) / F.sqrt("degree")).alias(n) for n in names)), "layout")
    seen = flat.agg(F.count(F.lit(1)), *(F.stddev_pop(n) for n in names), *(F.max_by(n, F.struct(F.abs(F.col(n)), n)) for n in names)).first()
    scale = [(1.0 if (seen[1 + len(names) + i] or 0) >= 0 else -1.0) / s if (s := seen[1 + i]) else 0.0 for i in range(len(names))]
    scaled = [F.col(n) * s for n, s in zip(names, scale)] + [F.lit(0.0)] * (components - len(names))
    drop_kept(near)
    return frame.join(flat.select(F.col("u").alias(key), F.array(*scaled).alias("reduced")), key, "left")
