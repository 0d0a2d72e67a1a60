"""k-modes and k-medians by rounds of assignment and update.

Centroids are k rows on the driver; rows are assigned by expressions, without a join. A round writes
its assignment, so lineage stays short; the search ends when no row changes its cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import seeded
from ..staging import drop_staged, stage
from .stats import modes, quantiles


def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _distance(vec: Column, centre: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(vec, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def _cosine(vec: Column, centre: Column) -> Column:
    dot = F.aggregate(F.zip_with(vec, centre, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    size = norm(vec) * norm(centre)
    return F.when(size > 0, dot / size).otherwise(0.0)


def assign(vec: Column, centroids: list[list[float]], metric: str) -> Column:
    """Number of the nearest centroid (the lowest among equals), by euclidean distance or cosine similarity."""
    if metric not in ("euclidean", "cosine"):
        raise ValueError("metric must be euclidean or cosine")
    best = [F.struct(F.round(-_cosine(vec, _array(c)) if metric == "cosine" else _distance(vec, _array(c)), 12).alias("d"), F.lit(i).alias("k")) for i, c in enumerate(centroids)]
    return (F.least(*best) if len(best) > 1 else best[0])["k"]


def init_centroids(df: DataFrame, key: str, vector: str, k: int = 3, seed: int = 0) -> list[list[float]]:
    """Vectors of the k rows with the lowest seeded hash, all different."""
    rows = df.where(F.col(vector).isNotNull()).groupBy(F.col(vector).cast("array<double>").alias("v")).agg(F.min(seeded(seed, F.col(key))).alias("h"))
    return [list(r["v"]) for r in rows.orderBy("h", "v").limit(k).collect()]


def _update(assigned: DataFrame, old: list[list[float]], kind: str) -> list[list[float]]:
    dims = assigned.select("cluster", F.posexplode("vec").alias("dim", "v"))
    key = ["cluster", "dim"]
    found = modes(dims, "v", key) if kind == "mode" else quantiles(dims, "v", [0.5], key).select(*key, F.col("q")[0].alias("value"))
    new = [list(c) for c in old]
    for r in found.collect():  # k x dimensions rows
        new[r["cluster"]][r["dim"]] = float(r["value"])
    if len({tuple(c) for c in new}) < len(new):
        raise ValueError("clusters collapsed: equal centroids after an update")
    return new


def _lloyd(df: DataFrame, key: str, vector: str, centroids: list[list[float]], metric: str, kind: str, max_rounds: int) -> tuple[DataFrame, list[list[float]]]:
    rows = stage(df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vec")), "vectors")
    now = stage(rows.withColumn("cluster", assign(F.col("vec"), centroids, metric)).withColumn("moved", F.lit(True)), "clusters")
    for _ in range(max_rounds):
        centroids = _update(now, centroids, kind)
        new = assign(F.col("vec"), centroids, metric)
        nxt = stage(now.select("key", "vec", new.alias("cluster"), (new != F.col("cluster")).alias("moved")), "clusters")
        drop_staged(now)
        now = nxt
        if not now.where("moved").take(1):
            break
    return now.select("key", "cluster"), centroids


def k_modes(df: DataFrame, key: str, vector: str, k: int = 3, centroids: list[list[float]] | None = None, seed: int = 0, max_rounds: int = 300) -> tuple[DataFrame, list[list[float]]]:
    """((key, cluster), centroids): nearest by cosine similarity, centroids by each dimension's mode
    (the smallest among equals; an empty cluster keeps its own)."""
    return _lloyd(df, key, vector, centroids or init_centroids(df, key, vector, k, seed), "cosine", "mode", max_rounds)


def k_medians(df: DataFrame, key: str, vector: str, k: int = 3, centroids: list[list[float]] | None = None, seed: int = 0, max_rounds: int = 300) -> tuple[DataFrame, list[list[float]]]:
    """((key, cluster), centroids): nearest by euclidean distance, centroids by each dimension's median."""
    return _lloyd(df, key, vector, centroids or init_centroids(df, key, vector, k, seed), "euclidean", "median", max_rounds)
