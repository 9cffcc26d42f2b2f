"""Centroid clustering with a pivot table (LAESA).

The distances of every vector to a few fixed pivots are computed once and stored with it. In a
round, the distances of the centroids to the pivots bound every vector's distance to every
centroid from below (triangle inequality); only centroids whose bound does not exceed the best
distance known get an exact one, in whole numbers. Rounds read the stored table and send one row
of sums per cluster and partition to the centroids' update; the driver sees the centroids only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletlens.session import materialise

POOL = 256  # vectors among which the pivots are chosen
LARGEST = 1 << 27  # whole components beyond this are taken as this, so that distances fit 64 bits

TABLE = "vec_id long, v array<int>, pivots array<long>"


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to ``y``, exact."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def whole(column, dims: int) -> np.ndarray:
    """Rows of an Arrow list column of numbers as floor(64 x), in whole numbers."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dims)
    return np.clip(np.floor(64 * x), -LARGEST, LARGEST).astype(np.int64)


def ints(column, dims: int) -> np.ndarray:
    """Rows of an Arrow list column of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def choose_pivots(pool: np.ndarray, count: int) -> np.ndarray:
    """Base prototypes: each time the vector of the pool with the largest distance summed over
    those chosen so far (the first one starts)."""
    if not len(pool):
        return pool
    chosen, total = [0], np.zeros(len(pool))
    while len(chosen) < min(count, len(pool)):
        total += np.sqrt(squares(pool, pool[chosen[-1]]))
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return pool[chosen]


def assign(v: np.ndarray, table: np.ndarray, pivots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number) and squared distance of each vector, and how many
    exact distances that took. ``table``: squared distances of the vectors to the pivots."""
    near = np.sqrt(table.astype(np.float64))
    bound = np.zeros((len(v), len(centroids)))
    for p in range(len(pivots)):
        far = np.sqrt(squares(centroids, pivots[p]).astype(np.float64))
        np.maximum(bound, np.abs(near[:, p, None] - far[None, :]), out=bound)
    bound = (bound * (1 - 1e-9)) ** 2  # roots are rounded
    cluster = bound.argmin(axis=1)
    best = squares(v, centroids[cluster])
    exact = len(v)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (cluster != c))
        exact += len(rows)
        d = squares(v[rows], centroids[c])
        better = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        best[rows[better]], cluster[rows[better]] = d[better], c
    return cluster, best, exact


def pivot_table(vectors: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """``vectors(vec_id, v)`` with their squared distances to the pivots, written."""
    def measure(batches):
        import pyarrow as pa

        for b in batches:
            v = ints(b.column("v"), dims)
            d = np.stack([squares(v, p) for p in pivots], axis=1) if len(pivots) else np.zeros((len(v), 0), np.int64)
            ends = np.arange(len(v) + 1, dtype=np.int32) * d.shape[1]
            yield pa.record_batch([b.column("vec_id"), b.column("v"), pa.ListArray.from_arrays(ends, d.ravel())], ["vec_id", "v", "pivots"])

    return materialise(vectors.mapInArrow(measure, TABLE))


def updated(table: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: floor of the exact mean of each one's vectors; empty ones stay."""
    dims = centroids.shape[1]

    def sums(batches):
        import pyarrow as pa

        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            v = ints(b.column("v"), dims)
            cluster, _, _ = assign(v, ints(b.column("pivots"), len(pivots)), pivots, centroids)
            count += np.bincount(cluster, minlength=len(centroids))
            for c in np.unique(cluster):
                total[c] += v[cluster == c].sum(axis=0)
        for c in np.flatnonzero(count):
            yield pa.record_batch([pa.array([c], pa.int64()), pa.array([count[c]], pa.int64()), pa.array([total[c].tolist()], pa.list_(pa.int64()))],
                                  ["cluster", "count", "total"])

    parts = table.mapInArrow(sums, "cluster long, count long, total array<long>")
    one = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("count").alias("count"), *one).collect():  # one row a centroid
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["count"] for i in range(dims)]
    return out


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3,
                    dims: int = 64, pivots: int = 8) -> DataFrame:
    """One row per vector of exactly ``dims`` components, none null or non-finite (others give no
    row): ``vec_id``, ``cluster``, ``distance`` (squared) to its centroid, ``cluster_inertia``, ``inertia``,
    ``centroid`` (its components).

    Components are floor(64 x); beyond 2^27 on either side they count as that. The first centroids
    are the ``k`` vectors with the least sha256 of ``1:<vec_id>``, fewer if there are fewer vectors. Of
    vectors that share an id the least one comes first; null ids come last, in the order of their
    vectors. The pivots are chosen among the ``POOL`` vectors with the least sha256 of ``2:<vec_id>``
    and only decide how many distances are computed. Repeated rows count each time; an empty
    table gives no row; other columns are not read."""
    sound = f"size({vec_col}) = {dims} and not exists({vec_col}, x -> x is null or isnan(x) or abs(double(x)) = double('Infinity'))"
    kept = vectors.filter(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))

    def floors(batches):
        import pyarrow as pa

        for b in batches:
            v = whole(b.column("v"), dims).astype(np.int32)
            ends = np.arange(len(v) + 1, dtype=np.int32) * dims
            yield pa.record_batch([b.column("vec_id"), pa.ListArray.from_arrays(ends, v.ravel())], ["vec_id", "v"])

    kept = kept.mapInArrow(floors, "vec_id long, v array<int>")

    def first(seed: str, n: int) -> np.ndarray:
        at = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        rows = kept.orderBy(at.asc_nulls_last(), "v").limit(n).select("v").collect()  # n is a parameter
        return np.array([r["v"] for r in rows], np.int64).reshape(-1, dims)

    base = choose_pivots(first("2", POOL), pivots)
    table = pivot_table(kept, base, dims)
    centroids = first("1", k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = updated(table, base, centroids)

    def nearest(batches):
        import pyarrow as pa

        for b in batches:
            cluster, best, _ = assign(ints(b.column("v"), dims), ints(b.column("pivots"), len(base)), base, centroids)
            yield pa.record_batch([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    placed = materialise(table.mapInArrow(nearest, "vec_id long, cluster int, distance long"))
    of_cluster = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = of_cluster.agg(F.sum("cluster_inertia")).scalar()
    named = placed.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster int, centroid array<long>")
    stats = of_cluster.join(named, "cluster").withColumn("inertia", total)
    return placed.join(stats, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(components: Column) -> Column:
    """sha256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(F.transform(components, lambda x: x.cast("string")), ","), 256)
