"""k-means on whole-number vectors, nearest centroids found by a tournament of bisectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: A scaled component must be smaller than this in size: squared distances of 64 such components fit 63 bits.
LARGEST = 1 << 27
#: Vectors that a task compares at once.
STEP = 4096


@dataclass
class Bisectors:
    """Centroids by number, with 2 (cj - ci) and |cj|^2 - |ci|^2 of each pair i < j:
    v is nearer to j than to i if and only if its product with the first exceeds the second."""

    centroids: np.ndarray
    normal: np.ndarray
    threshold: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Bisectors:
        square = (centroids * centroids).sum(1)
        return cls(centroids, 2 * (centroids[None] - centroids[:, None]), square[None] - square[:, None])

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each vector: the winner so far meets
        each next number, k - 1 signs in all; zero is a tie, which the smaller number wins."""
        won = np.zeros(len(vectors), np.int64)
        for j in range(1, len(self.centroids)):
            side = np.einsum("nd,nd->n", vectors, self.normal[won, j]) - self.threshold[won, j]
            won[side > 0] = j
        return won


def whole(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors with ``dims`` components, all finite, and floor(scale * x) of them."""
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False))
    at = np.flatnonzero(fits)
    flat = column.filter(pa.array(fits)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # null components become NaN
    fine = np.isfinite(x).all(1)
    v = np.floor(x[fine] * scale)
    if np.abs(v).max(initial=0) >= LARGEST:
        raise ValueError(f"a component of {LARGEST / scale:.0f} or more: squared distances would not fit a long")
    return at[fine], v.astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            part = batch.slice(lo, STEP)
            at, v = whole(part.column(1), dims, scale)
            yield part.column(0).take(pa.array(at)), v


def _start(vectors: DataFrame, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The k kept vectors with the smallest hashes of their ids; equal ids go by their components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    kept = vectors.where((F.size("embedding") == dims) & finite).select(told.alias("told"), "embedding")
    first = kept.orderBy(F.col("told").asc_nulls_last(), "embedding").limit(k).select("embedding").toArrow()
    return whole(first["embedding"].combine_chunks(), dims, scale)[1]


def _moved(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """Centroids after one round: exact sums by task, added up by cluster and component."""
    shared = vectors.sparkSession.sparkContext.broadcast(Bisectors.of(centroids))  # k centroids, k^2 pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, k = shared.value, len(shared.value.centroids)
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, v in _parts(batches, dims, scale):
            won = tree.nearest(v)
            for c in range(k):
                total[c] += v[won == c].sum(0)
            count += np.bincount(won, minlength=k)
        held = np.flatnonzero(count)
        cell = (held[:, None] * dims + np.arange(dims)).ravel()
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[held].ravel()), pa.array(np.repeat(count[held], dims))], ["cell", "total", "n"])

    out = centroids.copy()
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    for cell, total, n in vectors.mapInArrow(run, "cell long, total long, n long").groupBy("cell").agg(exact("total"), exact("n")).collect():
        out[cell // dims, cell % dims] = int(total) // int(n)
    return out


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector.

    Vectors of another length than ``dims``, null ones and those with a null or
    non-finite component are left out; other columns are not looked at.  The k
    vectors whose ids hash first start as centroids (a null id comes last, rows with
    one id go by their components; fewer than k vectors give fewer centroids), ties
    go to the smaller number, repeated rows count each.  Components of ``LARGEST`` /
    ``scale`` or more are refused with a ValueError.  An empty table gives an empty one.

    Each round is one scan that sends k sums of a task's vectors on; the driver gets
    k * dims of them.  No vector is shuffled.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    centroids = _start(rows, k, dims, scale, seed)
    for _ in range(rounds):
        centroids = _moved(rows, centroids, dims, scale)
    shared = rows.sparkSession.sparkContext.broadcast(Bisectors.of(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for ids, v in _parts(batches, dims, scale):
            won = tree.nearest(v)
            off = v - tree.centroids[won] if len(v) else v
            yield pa.RecordBatch.from_arrays([ids, pa.array(won.astype(np.int32)), pa.array((off * off).sum(1))], ["vec_id", "cluster", "distance"])

    assigned = stored(rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "assigned")
    told = [(n, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for n, c in enumerate(centroids)]
    names = rows.sparkSession.createDataFrame(told, "cluster int, centroid_sha256 string")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_sum"))
    both = sums.crossJoin(sums.agg(F.sum("cluster_sum").alias("all_sum"))).join(names, "cluster")
    # k rows at most
    return assigned.join(F.broadcast(both), "cluster").select(
        "vec_id", "cluster", "distance", F.col("cluster_sum").cast("long").alias("cluster_inertia"), F.col("all_sum").cast("long").alias("inertia"), "centroid_sha256"
    )
