"""Centroid clustering over exact integers, with an incremental distance matrix.

A vector's components become integers, and every vector keeps its exact dot products with all
centroids in a table.  A round changes a dot product only by the components of its centroid that
moved (``x . c' = x . c + sum of x_j * (c'_j - c_j)`` over the nonzero differences), adds the
squared lengths that both sides know, and recomputes the nearest centroid.  Cluster sums are kept
in the same way: only vectors that changed their cluster are read for them, added to the one and
taken from the other.

A round reads one table and writes the next, so that a lost executor repeats its own tasks only;
of these tables the last two stand at any time.  What reaches the driver is one vector, one count and
one distance a cluster, whatever the number of rows.

Cases: vectors that are null, have another number of components, or hold a null or non-finite one
take no part and are not returned; fewer vectors than clusters: each starts one; equal distances go
to the smaller number; a cluster that loses its last vector stays where it is; repeated rows count as
often as they occur; rows with a null id take part and start a cluster last; an empty table gives an
empty result; extra columns are ignored.  Distances are 64-bit integers: a component of ``2**27``
or more in units of ``1 / SCALE`` can't be squared and added within them, so such a vector raises an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, only, saved

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, "2"
#: Below it, squared distances of 64 components stay within 64 bits.
LARGEST = 1 << 27


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, the vectors of the right shape as integers."""
    real = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = only(vectors, vec_id=id_col, embedding=vector_col).where((F.size("embedding") == dimensions) & F.forall("embedding", real))
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    large = F.exists(whole, lambda v: F.abs(v) >= LARGEST)
    checked = F.when(large, F.raise_error(F.lit("a component is too large for distances of 64 bits"))).otherwise(whole)
    return rows.select("vec_id", checked.cast("array<int>").alias("x"))


def starts(rows: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(key.asc_nulls_last(), "x").limit(clusters).select("x").collect()
    return np.array([r.x for r in first], dtype=np.int64)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def _state(vec_type: str) -> str:
    return f"vec_id {vec_type}, x array<int>, length long, dots array<long>, cluster int, before int, distance long"


def _nearest(lengths: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distances = lengths[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)
    best = distances.argmin(axis=1)
    return best.astype(np.int32), distances[np.arange(len(best)), best]


def begun(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Every vector with its dot products with the first centroids, and its cluster."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), np.int64)
            lengths, dots = (x * x).sum(axis=1), x @ centroids.T
            best, distance = _nearest(lengths, dots, centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), pa.array(lengths), _lists(dots, pa.int64()), pa.array(best), pa.nulls(len(best), pa.int32()), pa.array(distance)],
                names=["vec_id", "x", "length", "dots", "cluster", "before", "distance"],
            )

    return rows.mapInArrow(run, _state(rows.dtypes[0][1]))


def moved(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The state after its centroids went from ``old`` to ``new``."""
    changes = [(k, np.flatnonzero(new[k] != old[k])) for k in range(len(new))]
    changes = [(k, at, new[k, at] - old[k, at]) for k, at in changes if len(at)]

    def run(batches):
        for batch in batches:
            x, dots = _matrix(batch.column("x"), np.int64), _matrix(batch.column("dots"), np.int64)
            for k, at, by in changes:
                dots[:, k] += x[:, at] @ by
            best, distance = _nearest(batch.column("length").to_numpy(), dots, new)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), batch.column("length"), _lists(dots, pa.int64()), pa.array(best), batch.column("cluster"), pa.array(distance)],
                names=["vec_id", "x", "length", "dots", "cluster", "before", "distance"],
            )

    return state.mapInArrow(run, state.schema)


def changed_sums(state: DataFrame, clusters: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed cluster add to each cluster's sum and count."""

    def fold(batches):
        sums = np.zeros((clusters, dimensions + 1), dtype=np.int64)  # the last place counts vectors
        for batch in batches:
            x = np.insert(_matrix(batch.column("x"), np.int64), dimensions, 1, axis=1)
            for name, sign in (("cluster", 1), ("before", -1)):
                who = batch.column(name).fill_null(-1).to_numpy()
                for k in np.unique(who[who >= 0]):
                    sums[k] += sign * x[who == k].sum(axis=0)
        k, place = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sums[k, place])], names=["cluster", "place", "v"])

    new = state.where(~F.col("cluster").eqNullSafe(F.col("before"))).select("x", "cluster", "before")
    parts = new.mapInArrow(fold, "cluster int, place int, v long")
    sums = np.zeros((clusters, dimensions + 1), dtype=np.int64)
    for r in parts.groupBy("cluster", "place").agg(F.sum("v").alias("v")).collect():
        sums[r.cluster, r.place] = r.v
    return sums[:, :dimensions], sums[:, dimensions]


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, cluster, distance) of every vector that is kept, and the centroids.

    ``rounds`` times vectors go to their nearest centroids and centroids to the floor of their vectors'
    means; then vectors are assigned once more.
    """
    rows = kept(vectors, dimensions, scale, id_col, vector_col)
    centroids = starts(rows, clusters, seed)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], f"vec_id {rows.dtypes[0][1]}, x array<int>, cluster int, distance long"), centroids
    centroids = centroids.reshape(-1, dimensions)
    sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
    state = saved(begun(rows, centroids), "clusters")
    for _ in range(rounds):
        more = changed_sums(state, len(centroids), dimensions)
        sums, counts = sums + more[0], counts + more[1]
        full = counts > 0
        new = centroids.copy()
        new[full] = sums[full] // counts[full, None]
        if (new == centroids).all():  # nothing would change any more
            break
        before, state = state, saved(moved(state, centroids, new), "clusters")
        dropped(before)
        centroids = new
    return state.select("vec_id", "x", "cluster", "distance"), centroids


def centroid_digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]


def _of_cluster(values: list) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.col("cluster"))


def report(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept."""
    found, centroids = clustered(vectors, clusters, rounds, dimensions, scale, seed, id_col, vector_col)
    found = found.drop("x")
    inertia = {r.cluster: r.n for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    each = [inertia.get(k, 0) for k in range(len(centroids))] or [0]
    digests = centroid_digests(centroids) or [""]
    return found.select("vec_id", "cluster", "distance", _of_cluster(each).cast("long").alias("cluster_inertia"), F.lit(sum(each)).cast("long").alias("inertia"), _of_cluster(digests).alias("centroid_sha256"))
