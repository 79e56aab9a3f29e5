"""Exact k-means of whole-number vectors with Shallot's bounds.

Every vector remembers its centroid, its second-nearest one and two bounds: its
distance to its own centroid is at most ``upper``, that to any other at least
``lower``. After the centroids have moved, both are shifted by the moves. A vector
whose upper bound is below its lower one, or below half the way from its centroid to
the next centroid, keeps its centroid unseen. Of the others the exact distances to
both remembered centroids are taken, and the centroids around the closer one are
scanned in order of their distance to it: none can be among the two nearest once
that exceeds the vector's distance to the start plus that to its second-nearest
so far, a ball that shrinks with each better centroid. Bounds carry a slack for
rounding; those that remain are compared by squared distances in whole numbers, so
ties go to the smaller number exactly.

Vectors with their bounds are written once a round to the shared folder (the round
before is deleted when the next one stands), so a lost executor costs its tasks
alone; there is no shuffle of vectors. What the driver holds is k centroids, their
sums and counts. Batches of vectors are numpy matrices inside the tasks.

Defined cases: vectors that are null, of another length or hold a component that is
null or not finite take no part; rows that repeat are vectors of their own; a null
id takes no part in the draw of first centroids unless fewer others are there;
first centroids with one id come in the order of their components; with fewer
than k vectors there are fewer centroids; centroids without vectors stay; an empty
table gives no rows. Components must be within 2^27 after scaling (an error
otherwise, as their squares would not fit a long).
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored_at

#: Largest component after scaling.
LIMIT = 1 << 27
_SLACK = 1e-9

STATE = "vec_id long, v array<long>, cluster int, second int, upper double, lower double"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integer_vectors(df: DataFrame, scale: int = 1024, size: int = 64) -> DataFrame:
    """(vec_id, v): the vectors of ``size`` finite components as floor(scale * x)."""
    ok = (F.size("embedding") == size) & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.select("vec_id", "embedding").where(F.col("embedding").isNotNull()).where(ok).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of the smallest SHA-256 of ``seed:id``."""
    name = F.sha2(F.concat(F.lit(seed + ":"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(name.asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    return np.array([r.v for r in rows], np.int64)


def square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


class Step:
    """One round: centroids, and how far each has moved since the bounds were set."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None):
        self.c, self.k = centroids, len(centroids)
        gaps = np.sqrt(((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2).astype(float))
        self.order = np.argsort(gaps, axis=1, kind="stable")
        for i in range(self.k):  # itself first, also where others lie on it
            at = int(np.nonzero(self.order[i] == i)[0][0])
            self.order[i, 1:at + 1] = self.order[i, :at].copy()
            self.order[i, 0] = i
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        self.half = self.gaps[:, 1] / 2 if self.k > 1 else np.full(1, np.inf)
        self.moved = moved
        if moved is not None:
            top = np.argsort(moved)[::-1]
            self.others = np.full(self.k, moved[top[0]])
            self.others[top[0]] = moved[top[1]] if self.k > 1 else 0.0

    def first(self, x: np.ndarray):
        """State of vectors that have none."""
        n = len(x)
        if self.k == 1:
            return np.zeros(n, np.int32), np.zeros(n, np.int32), np.sqrt(square(x, self.c[0]).astype(float)), np.full(n, np.inf)
        return self.search(x, np.zeros(n, np.int32), np.ones(n, np.int32))

    def next(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """State after the centroids have moved, and how many vectors were searched."""
        a, b = a.copy(), b.copy()
        upper = (upper + self.moved[a]) * (1 + _SLACK)
        lower = lower - self.others[a]
        lower = lower * np.where(lower > 0, 1 - _SLACK, 1 + _SLACK)
        open_ = np.nonzero(~self.sure(upper, lower, a))[0]
        upper[open_] = np.sqrt(square(x[open_], self.c[a[open_]]).astype(float))
        open_ = open_[~self.sure(upper[open_], lower[open_], a[open_])]
        if len(open_):
            a[open_], b[open_], upper[open_], lower[open_] = self.search(x[open_], a[open_], b[open_])
        return (a, b, upper, lower), len(open_)

    def sure(self, upper, lower, a):
        return upper * (1 + _SLACK) < np.maximum(lower, self.half[a]) * (1 - _SLACK)

    def search(self, x: np.ndarray, a: np.ndarray, b: np.ndarray):
        """Nearest and second-nearest centroids, from the closer of a and b outwards."""
        da, db = square(x, self.c[a]), square(x, self.c[b])
        swap = (db < da) | ((db == da) & (b < a))
        best, second = np.where(swap, b, a), np.where(swap, a, b)
        d1, d2 = np.where(swap, db, da), np.where(swap, da, db)
        start, reach = best.copy(), np.sqrt(d1.astype(float))
        live = np.arange(len(x))
        for j in range(1, self.k):
            s = start[live]
            ball = (reach[live] + np.sqrt(d2[live].astype(float))) * (1 + _SLACK)
            live = live[self.gaps[s, j] <= ball]
            if not len(live):
                break
            c = self.order[start[live], j]
            new = (c != a[live]) & (c != b[live])
            at, c = live[new], c[new].astype(np.int32)
            d = square(x[at], self.c[c])
            nearer = (d < d1[at]) | ((d == d1[at]) & (c < best[at]))
            i = at[nearer]
            second[i], d2[i] = best[i], d1[i]
            best[i], d1[i] = c[nearer], d[nearer]
            between = ~nearer & ((d < d2[at]) | ((d == d2[at]) & (c < second[at])))
            i = at[between]
            second[i], d2[i] = c[between], d[between]
        return best.astype(np.int32), second.astype(np.int32), np.sqrt(d1.astype(float)), np.sqrt(d2.astype(float))


def _assign(centroids: np.ndarray, moved: np.ndarray | None, last: bool):
    def assign(batches):
        step = Step(centroids, moved)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            if np.abs(x).max(initial=0) > LIMIT:
                raise ValueError(f"a component is beyond {LIMIT} after scaling")
            if moved is None:
                a, b, upper, lower = step.first(x)
            else:
                (a, b, upper, lower), _ = step.next(x, *(batch.column(i).to_numpy() for i in range(2, 6)))
            if last:
                yield pa.record_batch([batch.column(0), pa.array(a, pa.int32()), pa.array(square(x, step.c[a]), pa.int64())],
                                      ["vec_id", "cluster", "distance"])
            else:
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                                       pa.array(upper, pa.float64()), pa.array(lower, pa.float64())],
                                      ["vec_id", "v", "cluster", "second", "upper", "lower"])
    return assign


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the clusters' means; k rows reach the driver."""
    size = centroids.shape[1]
    rows = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("v")[i]) for i in range(size)]).alias("s")).collect()
    new = centroids.copy()
    for r in rows:
        new[r.cluster] = [s // r.n for s in r.s]
    return new


def k_means(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3") -> DataFrame:
    """``RESULT``: the cluster of each vector of (vec_id, v array<long>), all of one
    length, after ``rounds`` rounds, its squared distance, that summed over the
    cluster and over all, and the SHA-256 of the cluster's centroid."""
    spark = vectors.sparkSession
    now, path = stored_at(vectors.select("vec_id", "v"), "vectors")
    centroids, moved = first_centroids(now, k, seed), None
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    for _ in range(rounds):
        state, at = stored_at(now.mapInArrow(_assign(centroids, moved, False), STATE), "assigned")
        discard(spark, path)
        now, path = state, at
        new = _means(now, centroids)
        moved = np.sqrt(square(new, centroids).astype(float)) * (1 + _SLACK)
        centroids = new
    out, _ = stored_at(now.mapInArrow(_assign(centroids, moved, True), "vec_id long, cluster int, distance long"), "clusters")
    discard(spark, path)
    sums = out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # k rows
    total = sum(r.s for r in sums)
    named = [(r.cluster, r.s, total, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in sums]
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
