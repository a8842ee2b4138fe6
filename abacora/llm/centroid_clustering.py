"""Centroid clustering over integer vectors with partial-distance search.

Components become integers floor(scale * x); from there on all arithmetic is exact. Every round is one
pass over the vectors: a task assigns its vectors to the nearest centroid (squared Euclidean distance, ties
to the smaller number) and hands on at most one row of exact sums per cluster, so a cluster or vector that
holds most rows costs no more than any other. The driver sees `k` centroids, sums and counts, never vectors.

Partial-distance search: dimensions are taken in order of falling variance (measured over all vectors),
BLOCK at a time. The centroid nearest by the first block is measured in full and gives each vector's current
best; every other centroid adds integer squared differences block by block and is abandoned once its sum is
strictly above the best; survivors finish all dimensions. A centroid that could tie is never abandoned.

Edge cases: vectors of another length, null vectors, and vectors with a null, NaN or infinite component are
left out; repeated rows count as often as they occur; the starting centroids are the vectors with the smallest
digests of their ids, rows of one id in order of their components, null ids last; fewer vectors than `k` give
fewer centroids; an empty table gives no rows; empty clusters keep their centroid; other columns are ignored.
Components beyond +-2**27 as integers end the job with an error, since distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
#: Dimensions added before centroids are abandoned again.
BLOCK = 8
#: Vectors worked on at once.
ROWS = 4096
MOST = 1 << 27
CLUSTERED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """id and v (array of long) of every usable vector."""
    raw = table.select(table[id_col].cast("long").alias("id"), table[vector_col].cast("array<double>").alias("x"))
    usable = (F.size("x") == dimensions) & F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    whole = lambda x: F.when(F.abs(x * float(scale)) < MOST, F.floor(x * float(scale))).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long"))
    return raw.filter(usable).select("id", F.transform("x", whole).alias("v"))


def seeds(vecs: DataFrame, k: int = K, salt: int = 2) -> np.ndarray:
    """The k vectors with the smallest sha256 of '<salt>:<id>', in that order (k rows reach the driver)."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = vecs.select(digest.alias("d"), "v").orderBy(F.col("d").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def spread_order(vecs: DataFrame, d: int) -> np.ndarray:
    """Dimensions by falling variance over all vectors; one row of sums per task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, d))
        for batch in batches:
            x = _matrix(batch.column(0), d).astype(float)
            total += [np.full(d, len(x)), x.sum(0), (x * x).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), *(pa.array(t) for t in total)], names=["dim", "n", "s", "q"])

    found = vecs.select("v").mapInArrow(sums, "dim int, n double, s double, q double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()  # d rows
    spread = {r["dim"]: r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 if r["n"] else 0.0 for r in found}
    return np.array(sorted(range(d), key=lambda i: (-spread.get(i, 0.0), i)), np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and the squared distance by row, and how many (vector, centroid) pairs finished; columns in search order."""
    n, d = x.shape
    head = min(block, d)
    partial = np.zeros((n, len(centroids)), np.int64)
    for j in range(head):
        step = x[:, j, None] - centroids[None, :, j]
        partial += step * step
    guess = partial.argmin(1)
    gap = x - centroids[guess]
    best = (gap * gap).sum(1)
    row, cent = np.nonzero(partial <= best[:, None])
    total = partial[row, cent]
    for j in range(head, d, block):
        gap = x[row, j : j + block] - centroids[cent, j : j + block]
        total = total + (gap * gap).sum(1)
        alive = total <= best[row]
        row, cent, total = row[alive], cent[alive], total[alive]
    order = np.lexsort((cent, total, row))
    row, cent, total = row[order], cent[order], total[order]
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    return cent[first], total[first], len(row)


def _assign(v: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = np.ascontiguousarray(centroids[:, order])
    parts = [nearest(np.ascontiguousarray(v[i : i + ROWS][:, order]), c)[:2] for i in range(0, len(v), ROWS)]
    return np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)]), np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])


def _sums(vecs: DataFrame, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[int]]:
    """Exact count, component sums and summed distance of every cluster (k rows reach the driver)."""
    k, d = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, far = np.zeros(k, np.int64), np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), d)
            cluster, distance = _assign(v, centroids, order)
            n += np.bincount(cluster, minlength=k)
            np.add.at(far, cluster, distance)
            by = np.argsort(cluster, kind="stable")
            at, first = np.unique(cluster[by], return_index=True)
            if len(at):
                s[at] += np.add.reduceat(v[by], first, axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(far[used]), pa.array(s[used].tolist(), pa.list_(pa.int64()))], names=["c", "n", "far", "s"])

    parts = vecs.select("v").mapInArrow(add, "c int, n long, far long, s array<long>")
    total = parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), F.array(*(F.sum(F.col("s")[i]) for i in range(d))).alias("s")).collect()
    n, s, far = np.zeros(k, np.int64), [[0] * d for _ in range(k)], [0] * k
    for r in total:
        n[r["c"]], s[r["c"]], far[r["c"]] = r["n"], r["s"], r["far"]
    return n, s, far


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    vecs = vectors(table, id_col, vector_col, dimensions, scale)
    centroids = seeds(vecs, k)
    if not len(centroids):
        return table.sparkSession.createDataFrame([], CLUSTERED)
    order = spread_order(vecs, dimensions)
    for _ in range(rounds):
        n, s, _ = _sums(vecs, centroids, order)
        centroids = np.array([[t // int(n[c]) for t in s[c]] if n[c] else centroids[c] for c in range(len(centroids))], np.int64)
    _, _, far = _sums(vecs, centroids, order)
    digests = np.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids])
    inertia, whole = np.array(far, np.int64), sum(far)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, distance = _assign(_matrix(batch.column(1), dimensions), centroids, order)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(at, pa.int32()), pa.array(distance), pa.array(inertia[at]), pa.array(np.full(len(at), whole, np.int64)), pa.array(digests[at], pa.string())],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return vecs.mapInArrow(place, CLUSTERED)
