"""Clustering of whole-number vectors around centroids: a progressive search over Walsh-Hadamard coefficients.

The transform H of 64 numbers has entries of 1 and -1 only, so vectors of whole numbers keep whole coefficients, and
64 * |x - c|^2 = |Hx - Hc|^2 exactly. Coefficients are summed coarse to fine (by the sign changes of their rows): a
partial sum never exceeds the whole one, so a centroid whose partial sum is above the full distance of another one is
strictly worse and goes. Those that stay are carried through all 64 coefficients, so ties are seen as ties.

Vectors never meet: each task assigns its own and sends one sum per centroid; what the driver holds is k centroids.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
#: Coefficients after which worse centroids are put aside.
STAGES = (4, 8, 16, 32, 64)
#: Vectors that are compared with all centroids together.
BLOCK = 2048
#: Largest size of a component for which sums of 64 squared differences of coefficients stay below 2**62.
SMALL = 1 << 20
_LONG = (1 << 63) - 1


@functools.cache
def coarse_to_fine() -> np.ndarray:
    """Numbers of the transform's rows, in the order of their sign changes."""
    rows = np.array([[1]])
    while len(rows) < DIMENSIONS:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.argsort((np.diff(rows, axis=1) != 0).sum(axis=1))


def transform(vectors: np.ndarray) -> np.ndarray:
    """Coefficients of each row: additions and subtractions in six steps, then put coarse to fine."""
    out = vectors
    half = 1
    while half < DIMENSIONS:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(out), DIMENSIONS)
        half *= 2
    return out[:, coarse_to_fine()]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each vector, ties to the smaller number."""
    kind = np.int64 if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= SMALL else object
    of_centroids = transform(centroids.astype(kind))
    number, distance = [], []
    for at in range(0, len(vectors), BLOCK):
        x = transform(vectors[at : at + BLOCK].astype(kind))
        coarse = ((x[:, None, : STAGES[0]] - of_centroids[None, :, : STAGES[0]]) ** 2).sum(axis=2)
        likely = coarse.argmin(axis=1)
        bound = ((x - of_centroids[likely]) ** 2).sum(axis=1)
        row, centroid = np.nonzero(coarse <= bound[:, None])
        partial = coarse[row, centroid]
        for begin, end in zip(STAGES, STAGES[1:], strict=False):
            partial = partial + ((x[row, begin:end] - of_centroids[centroid, begin:end]) ** 2).sum(axis=1)
            if end == DIMENSIONS:
                np.minimum.at(bound, row, partial)
            left = partial <= bound[row]
            row, centroid, partial = row[left], centroid[left], partial[left]
        first = np.searchsorted(row, np.arange(len(x)))  # rows in order, centroids ascending within a row
        number.append(centroid[first])
        distance.append(partial[first] // DIMENSIONS)
    return np.concatenate(number), np.concatenate(distance)


def _assign(centroids: list[list[int]]):
    """Arrow batches (..., q) -> the same columns but q, with cluster and distance (null where it doesn't fit a long)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _matrix(centroids)
        for batch in batches:
            number, distance = nearest(_rows(batch.column(batch.num_columns - 1)), known) if batch.num_rows else ([], [])
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(number, pa.int32()), pa.array([d if d <= _LONG else None for d in map(int, distance)], pa.int64())],
                names=[*batch.schema.names[:-1], "cluster", "distance"],
            )

    return assign


def _sums(centroids: list[list[int]]):
    """Arrow batches (q) -> per task and centroid with vectors: cluster, n, the sum of each component."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _matrix(centroids)
        n, total = np.zeros(len(known), np.int64), np.zeros(known.shape, known.dtype)
        for batch in batches:
            if batch.num_rows:
                vectors = _rows(batch.column(0))
                number, _ = nearest(vectors, known)
                n += np.bincount(number, minlength=len(known))
                order = np.argsort(number, kind="stable")
                starts = np.flatnonzero(np.diff(number[order], prepend=-1))
                total[number[order][starts]] += np.add.reduceat(vectors[order], starts, axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(total[used].astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return sums


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMENSIONS)


def _matrix(centroids: list[list[int]]) -> np.ndarray:
    return np.array(centroids, np.int64).reshape(-1, DIMENSIONS)


def scaled(vector: Column) -> Column:
    """Components as whole numbers, floor(256 * x) with x as double; null unless there are 64 finite ones that stay
    below 2**40."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 32)))
    return F.when((F.size(v) == DIMENSIONS) & fine, F.transform(v, lambda x: F.floor(256 * x)))


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, have not exactly 64 components, or hold a null, a NaN or an infinity take no part and don't
    come back; neither do vectors with a component of 2**32 or more, whose squared distances no long can hold. Centroids
    start as the k vectors with the smallest sha256 of `<seed>:<vec_id>`, all of them if there are fewer than k; a null
    vec_id is no start, but is assigned. Rows that share a vec_id are vectors of their own; among them the start is the
    smallest vector. Each round assigns all vectors and moves each centroid that has any to the floor of their mean. An
    empty table, or one without any start, gives no row. Other columns are ignored, whatever their names.

    distance is the squared distance to the final centroid, cluster_inertia and inertia its sums over the cluster and
    over all; a distance of 2**63 or more is null and left out of the sums, and such a sum is null too.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id"), scaled(F.col("embedding")).alias("q")).where("q is not null")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.where("vec_id is not null").select(order.alias("o"), "q").orderBy("o", "q").limit(k)
    centroids = [list(r.q) for r in starts.collect()]  # k rows at most
    if not centroids:
        return spark.createDataFrame([], _result(vectors))
    only = kept.select("q")
    for _ in range(rounds):
        parts = only.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
        each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        for r in each.collect():  # k centroids of 64 components at most
            centroids[r.cluster][r.i] = int(r.s) // r.n
    assigned = kept.mapInArrow(_assign(centroids), f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")
    inertia = {r.cluster: int(r.s or 0) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda x: x if x <= _LONG else None
    facts = spark.createDataFrame([(i, fits(inertia.get(i, 0)), digests[i]) for i in range(len(centroids))], "cluster int, cluster_inertia long, centroid_sha256 string")
    total = fits(sum(inertia.values()))
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256"
    )


def _result(vectors: DataFrame) -> str:
    return f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
