"""Centroid clustering of vectors, exact in integers, by partial-distance search.

Components become integers floor(scale * x).  Centroids start as the vectors with the
smallest hashes; each round assigns every vector to its nearest centroid and replaces a
centroid by the componentwise floor of its vectors' mean.

Search.  The dimensions are ordered by their variance over all vectors, highest first.
For one centroid after the other, a block of vectors adds up squared differences along
that order and abandons the centroid for each vector whose partial sum is strictly above
its best distance so far; what survives all dimensions replaces the best where it is
strictly smaller, so that a tie stays with the smaller number.  The order of the
dimensions changes the work, never the result.

Scale.  A round reads the vectors once and sends each task's sums, at most k * dims
numbers, to be added in the cluster; the driver holds the centroids only.  The assignments
(an id and two numbers a vector) are written to the shared folder before their sums are
attached.

Cases: a vector that is null, has another length, a null or non-finite component or one
that overflows when scaled is left out; a null vec_id is hashed as the empty text;
repeated rows are vectors of their own, and equal hashes go by the components; with fewer vectors than centroids there are as many centroids as vectors; an empty table
gives an empty table; components beyond 2^27 are computed with unbounded integers, and
distances and sums beyond a long are given as the largest long; columns that the operator
doesn't name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import cut

_SMALL, _LARGEST = 1 << 27, (1 << 63) - 1
_LIMB = 60
_BLOCK, _STEP = 4096, 8


def usable(vectors: DataFrame, dims: int = 64, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector): vectors of that many finite components."""
    of = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x * scale) < float("inf"), F.lit(False)))
    return of.where((F.size("vector") == dims) & finite)


def integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a column of vectors, a row each; Python integers where a component is large."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) * float(scale))
    if x.size and np.abs(x).max() >= _SMALL:
        return np.frompyfunc(int, 1, 1)(x).reshape(-1, dims)
    return x.astype(np.int64)


def table(centroids: list[list[int]]) -> np.ndarray:
    large = any(abs(x) >= _SMALL for c in centroids for x in c)
    return np.array(centroids, dtype=object if large else np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid and its squared distance."""
    kind = object if object in (x.dtype, centroids.dtype) else np.int64
    number, best = np.zeros(len(x), np.int32), np.zeros(len(x), kind)
    c = centroids[:, order]
    for a in range(0, len(x), _BLOCK):
        v = x[a : a + _BLOCK][:, order]
        least, who = ((v - c[0]) ** 2).sum(1), number[a : a + _BLOCK]
        for k in range(1, len(c)):
            alive, far = np.arange(len(v)), np.zeros(len(v), kind)
            for s in range(0, len(order), _STEP):
                far = far + ((v[alive, s : s + _STEP] - c[k, s : s + _STEP]) ** 2).sum(1)
                stays = (far <= least[alive]).astype(bool)  # abandoned once strictly above the best
                alive, far = alive[stays], far[stays]
                if not len(alive):
                    break
            closer = (far < least[alive]).astype(bool)
            who[alive[closer]], least[alive[closer]] = k, far[closer]
        best[a : a + _BLOCK] = least
    return number, best


def limbs(n: int) -> list[int]:
    """Longs that give n as sum(limb * 2^(60 * place))."""
    out = []
    while not -(1 << 62) <= n < 1 << 62:
        out.append(n & (1 << _LIMB) - 1)
        n >>= _LIMB
    return [*out, n]


def by_variance(vectors: DataFrame, dims: int, scale: int) -> list[int]:
    """Dimensions in order of their variance over all vectors, highest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = integers(batch.column(0), dims, scale).astype(float)
            n, total, squares = n + len(x), total + x.sum(0), squares + (x * x).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": np.arange(dims, dtype=np.int32), "n": np.full(dims, n), "total": total, "squares": squares})

    sums = vectors.select("vector").mapInArrow(run, "dim int, n bigint, total double, squares double").groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")))
    var = np.zeros(dims)
    for r in sums.collect():
        var[r.dim] = r.squares / r.n - (r.total / r.n) ** 2
    return np.argsort(-np.nan_to_num(var), kind="stable").tolist()


def start(vectors: DataFrame, k: int, scale: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.withColumn("hash", F.sha2(key, 256)).orderBy("hash", "vector").limit(k)
    return [[int(np.floor(x * scale)) for x in r.vector] for r in first.select("vector").collect()]


def moved(vectors: DataFrame, centroids: list[list[int]], order: list[int], scale: int) -> list[list[int]]:
    """The centroids after one round."""
    dims, c = len(order), table(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * len(c), [[0] * dims for _ in c]
        for batch in batches:
            x = integers(batch.column(0), dims, scale)
            number, _ = nearest(x, c, order)
            for k in np.unique(number).tolist():
                own = x[number == k]
                counts[k] += len(own)
                sums[k] = [a + int(b) for a, b in zip(sums[k], own.sum(0), strict=True)]
        rows = [(k, d, place, limb) for k, n in enumerate(counts) if n for d, total in enumerate([*sums[k], n]) for place, limb in enumerate(limbs(total))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["k", "dim", "place", "limb"])

    parts = vectors.select("vector").mapInArrow(run, "k int, dim int, place int, limb bigint")
    parts = parts.groupBy("k", "dim", "place").agg(F.sum(F.col("limb").cast("decimal(38,0)")).alias("limb"))
    total: dict[int, list[int]] = {}
    for r in parts.collect():  # at most k * (dims + 1) * places
        total.setdefault(r.k, [0] * (dims + 1))[r.dim] += int(r.limb) << _LIMB * r.place
    return [[s // total[k][dims] for s in total[k][:dims]] if k in total else old for k, old in enumerate(centroids)]


def fit(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> tuple[list[list[int]], list[int]]:
    """Centroids after all rounds, and the order of the dimensions, from the rows of usable()."""
    centroids = start(vectors, k, scale, seed)
    order = by_variance(vectors, dims, scale) if centroids else list(range(dims))
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids, order, scale)
    return centroids, order


def assign(vectors: DataFrame, centroids: list[list[int]], order: list[int], scale: int = 64) -> DataFrame:
    """(vec_id, cluster, distance) of the rows of usable()."""
    dims, c = len(order), table(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, far = nearest(integers(batch.column(1), dims, scale), c, order)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), pa.array(np.minimum(far, _LARGEST).astype(np.int64))], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "vector").mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    of = usable(vectors, dims, scale, vec_id, vector)
    centroids, order = fit(of, k, rounds, dims, scale, seed)
    if not centroids:
        return of.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    out = cut(assign(of, centroids, order, scale))
    sums = {r.cluster: int(r.n) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    own = [min(sums.get(i, 0), _LARGEST) for i in range(len(centroids))]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = F.col("cluster")
    return out.withColumns({
        "cluster_inertia": F.array(*(F.lit(x).cast("bigint") for x in own))[at],
        "inertia": F.lit(min(sum(sums.values()), _LARGEST)).cast("bigint"),
        "centroid_sha256": F.array(*map(F.lit, hashes))[at],
    })
