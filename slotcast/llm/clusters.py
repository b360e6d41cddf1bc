r"""Exact k-means over integer vectors with Shallot search.

Vectors are turned into integers once. Each keeps, from round to round, its
centroid and its second-nearest one, an upper bound of the distance to the first
and a lower bound of the distance to all others. When centroids have moved:

* the bounds are moved along; a vector whose upper bound stays below the lower
  one, or below half the way to the centroid's nearest neighbour, is left alone,
  first by its bound, then by its exact distance;
* others measure both remembered centroids and start from the closer one. Its
  neighbours are scanned in order of their distance to it and only inside the
  ball whose radius is the vector's distance to the start plus that to the second
  best so far; each better second best shrinks the ball, which ends the scan;
* who survives is compared by exact integer squared distance, ties by number.

So results equal those of a full search. Bounds are doubles with a margin for
rounding; they only decide what is looked at.

The state of a round is a stored table: a lost executor costs one pass. Sums of a
round are partial aggregates; only ``k`` rows of them reach the driver, which has
the centroids (k * width numbers, k at most ``MOST``).

Defined results: rows whose vector is null, of another width, or holds a null or a
non-finite number are left out; a component beyond 2**27 ends the job, since its
squared distances would not fit a long; with fewer than k vectors there are as
many centroids; repeated rows are vectors of their own (as first centroids too, in
order of id and components); null ids hash as empty text; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.llm.store import release, settled, stored

WIDTH = 64
K = 40
ROUNDS = 5
SCALE = 256
SEED = 2
MOST = 4096
LARGEST = 1 << 27
_ROWS = 8192

STATE = "vec_id long, v array<long>, cluster int, second int, upper double, lower double"


def whole_vectors(embeddings: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that count, each component x as the integer floor(scale * x)."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    known = embeddings.select("vec_id", x.alias("x")).filter(
        (F.size("x") == width) & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    )
    far = F.exists("x", lambda e: F.abs(e) * scale > LARGEST)
    wrong = F.raise_error(F.concat(F.lit("component out of range in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))
    return known.select(
        "vec_id",
        F.when(far, wrong.cast("array<bigint>")).otherwise(F.transform("x", lambda e: F.floor(e * float(scale)))).alias("v"),
    )


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose seeded id hashes lowest, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(name.cast("binary"), 256), "vec_id", "v").select("v").limit(k).collect()
    return np.array([r[0] for r in rows], np.int64)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by distance, ties by number, and these distances."""
    k = len(centroids)
    squared = np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids])
    np.fill_diagonal(squared, -1)
    order = np.argsort(squared, axis=1, kind="stable")[:, 1:]
    return order, np.sqrt(np.take_along_axis(squared, order, axis=1).astype(float)).reshape(k, k - 1)


def moved_by(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.sqrt(((new - old) ** 2).sum(axis=1).astype(float))


_MARGIN = 1e-9


def assign(
    v: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray,
    centroids: np.ndarray, order: np.ndarray, apart: np.ndarray, moved: np.ndarray,
) -> int:
    """Brings the state of some vectors up to date in place; the number of distances measured."""
    k, measured = len(centroids), 0
    if k == 1:
        cluster[:], second[:], upper[:], lower[:] = 0, 0, np.inf, 0.0
        return 0

    def squared(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        nonlocal measured
        measured += len(rows)
        gap = v[rows] - centroids[to]
        return np.einsum("ij,ij->i", gap, gap)

    # a lower bound falls by the largest way of any other centroid
    most = int(moved.argmax())
    rest = np.where(np.arange(k) == most, np.delete(moved, most).max(), moved[most])
    upper += moved[cluster]
    lower -= rest[cluster]
    np.maximum(lower, 0.0, out=lower)
    half = apart[:, 0] / 2
    safe = lambda u, l, c: u * (1 + _MARGIN) + _MARGIN < np.maximum(l, half[c])
    open_ = np.flatnonzero(~safe(upper, lower, cluster))
    if not len(open_):
        return measured
    one = squared(open_, cluster[open_])
    upper[open_] = np.sqrt(one)
    still = ~safe(upper[open_], lower[open_], cluster[open_])
    open_, one = open_[still], one[still]
    if not len(open_):
        return measured
    # both remembered centroids; the scan starts from the closer one
    best, other = cluster[open_].astype(np.int64), second[open_].astype(np.int64)
    two = squared(open_, other)
    swap = (two < one) | ((two == one) & (other < best))
    best[swap], other[swap] = other[swap], best[swap]
    one[swap], two[swap] = two[swap], one[swap]
    start, from_start = best.copy(), np.sqrt(one.astype(float))
    now = np.arange(len(open_))
    for place in range(k - 1):
        radius = from_start[now] + np.sqrt(two[now].astype(float))
        now = now[apart[start[now], place] <= radius * (1 + _MARGIN) + _MARGIN]
        if not len(now):
            break
        to = order[start[now], place]
        fresh = (to != best[now]) & (to != other[now])
        rows, to = now[fresh], to[fresh]
        gap = squared(open_[rows], to)
        nearer = (gap < one[rows]) | ((gap == one[rows]) & (to < best[rows]))
        a, b = rows[nearer], rows[~nearer]
        two[a], other[a] = one[a], best[a]
        one[a], best[a] = gap[nearer], to[nearer]
        gap, to = gap[~nearer], to[~nearer]
        closer = (gap < two[b]) | ((gap == two[b]) & (to < other[b]))
        two[b[closer]], other[b[closer]] = gap[closer], to[closer]
    cluster[open_], second[open_] = best, other
    upper[open_], lower[open_] = np.sqrt(one.astype(float)), np.sqrt(two.astype(float))
    return measured


def _assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The state after one assignment, with ``distance``, the exact squared one."""
    order, apart = neighbours(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                vectors = batch.column(1)
                v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), -1)
                cluster, second, upper, lower = (np.array(batch.column(i)) for i in range(2, 6))
                assign(v, cluster, second, upper, lower, centroids, order, apart, moved)
                gap = v - centroids[cluster]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), vectors, *map(pa.array, (cluster, second, upper, lower, (gap * gap).sum(axis=1)))],
                    names=["vec_id", "v", "cluster", "second", "upper", "lower", "distance"],
                )

    return state.mapInArrow(run, f"{STATE}, distance long")


def _updated(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the means; a centroid without vectors stays."""
    sums = [F.sum(F.col("v")[i]) for i in range(centroids.shape[1])]
    new = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("sums")).collect():
        new[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return new


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The rows of ``whole_vectors`` with cluster, second and distance, and the final centroids."""
    if not 0 < k <= MOST:
        raise ValueError(f"between 1 and {MOST} centroids")
    vectors = stored(vectors)
    centroids = first_centroids(vectors, k, seed)
    state = vectors.selectExpr(
        "vec_id", "v", "0 AS cluster", f"{min(1, max(len(centroids) - 1, 0))} AS second",
        "double('infinity') AS upper", "0D AS lower",
    )
    if not len(centroids):
        return state.withColumn("distance", F.lit(0).cast("long")), centroids
    moved, before = np.zeros(len(centroids)), vectors
    for _ in range(rounds):
        now = stored(_assigned(state, centroids, moved))
        release(before)
        new = _updated(now, centroids)
        moved, centroids = moved_by(centroids, new), new
        before, state = now, now.drop("distance")
    done = stored(_assigned(state, centroids, moved))
    release(before)
    return done, centroids


def cluster_table(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that counts."""

    def make() -> DataFrame:
        done, centroids = clustered(whole_vectors(embeddings), k, rounds)
        spark = embeddings.sparkSession
        names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
        sums = {r[0]: r[1] for r in done.groupBy("cluster").agg(F.sum("distance")).collect()}
        total = sum(sums.values())
        table = spark.createDataFrame(
            [(i, sums.get(i, 0), total, name) for i, name in names],
            "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
        )
        # one row per centroid: at most MOST
        return done.select("vec_id", "cluster", "distance").join(F.broadcast(table), "cluster").select(
            "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
        )

    return settled(embeddings.sparkSession, make)
