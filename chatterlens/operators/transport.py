"""Exact optimal transport between word clouds (X03), by prune and refine.

A cloud is the bounded list of a post's first in-vocabulary words with vectors and
weights (X02: ``similarity.clouds`` with its ``cut_off``).  The cost of two words is
their squared distance divided by the pair's largest cost.  For every pair the relaxed
bound comes first: each side's words go to their nearest words without regard to the
other side's weights, and the larger of the two sums is below the optimum.  Pairs
whose bound is beyond the radius are dropped; for the others the optimum is found by
successive shortest augmenting paths, exact up to rounding, for all pairs of a batch
together.

Spark pairs and spreads the rows; the two clouds of a pair (``cut_off`` words each)
are numpy arrays inside the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .similarity import cloud_arrays

_EPS = 1e-12


def costs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances over the largest one (zeros where all are equal)."""
    c = ((x[:, None, :] - y[None, :, :]) ** 2).sum(2)
    top = c.max(initial=0)
    return c / top if top > 0 else c


def relaxed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    """The larger of the two one-sided bounds; never above :func:`optimum`."""
    return float(max((a * c.min(1)).sum(), (b * c.min(0)).sum()))


def optimum(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    """Least cost of moving the weights ``a`` onto ``b`` (equal sums)."""
    n, m = c.shape
    supply, demand = a.astype(float).copy(), b.astype(float).copy()
    flow, pu, pv = np.zeros((n, m)), np.zeros(n), np.zeros(m)
    while supply.max() > _EPS and demand.max() > _EPS:
        du, dv = np.where(supply > _EPS, 0.0, np.inf), np.full(m, np.inf)
        open_u, open_v = np.ones(n, bool), np.ones(m, bool)
        from_u, from_v = np.full(n, -1), np.full(m, -1)
        while True:
            i, j = int(np.argmin(np.where(open_u, du, np.inf))), int(np.argmin(np.where(open_v, dv, np.inf)))
            best_u, best_v = (du[i] if open_u[i] else np.inf), (dv[j] if open_v[j] else np.inf)
            if best_v <= best_u:
                if demand[j] > _EPS:
                    break
                open_v[j] = False
                way = best_v + np.maximum(pv[j] - pu - c[:, j], 0)  # back along what flows into j
                nearer = open_u & (flow[:, j] > _EPS) & (way < du)
                du[nearer], from_u[nearer] = way[nearer], j
            else:
                open_u[i] = False
                way = best_u + np.maximum(c[i] + pu[i] - pv, 0)
                nearer = open_v & (way < dv)
                dv[nearer], from_v[nearer] = way[nearer], i
        end = dv[j]
        pu += np.minimum(du, end)
        pv += np.minimum(dv, end)
        path, at = [], j
        while True:  # back to a word with supply
            i = from_v[at]
            path.append((i, at, 1))
            if from_u[i] < 0:
                break
            path.append((i, from_u[i], -1))
            at = from_u[i]
        amount = min(supply[i], demand[j], *[flow[p, q] for p, q, sign in path if sign < 0])
        for p, q, sign in path:
            flow[p, q] += sign * amount
        supply[i] -= amount
        demand[j] -= amount
    return float((flow * c).sum())


def optima(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """:func:`optimum` of many pairs at once: weights ``a`` (pairs, n) and ``b`` (pairs, m),
    short clouds filled up with weights of zero, costs ``c`` (pairs, n, m).  All pairs take
    one shortest augmenting path a round; those that are done leave."""
    out = np.zeros(len(a))
    index = np.arange(len(a))
    supply, demand, flow = a.astype(float).copy(), b.astype(float).copy(), np.zeros(c.shape)
    real_u, real_v = supply > 0, demand > 0
    c = np.where(real_u[:, :, None] & real_v[:, None, :], c, np.inf)
    price = np.where(np.isfinite(c), c, 0.0)
    while len(index):
        going = (supply.max(1, initial=0) > _EPS) & (demand.max(1, initial=0) > _EPS)
        if not going.all():
            out[index[~going]] = (flow[~going] * price[~going]).sum((1, 2))
            index, supply, demand, flow, c, price = index[going], supply[going], demand[going], flow[going], c[going], price[going]
            if not len(index):
                break
        at = np.arange(len(index))
        du = np.where(supply > _EPS, 0.0, np.inf)
        dv = np.full(demand.shape, np.inf)
        from_u, from_v = np.full(du.shape, -1), np.full(dv.shape, -1)
        while True:  # distances in the residual network, until none falls
            way = du[:, :, None] + c
            near, by = way.min(1), way.argmin(1)
            better = near < dv - _EPS
            dv, from_v = np.where(better, near, dv), np.where(better, by, from_v)
            back = np.where(flow > _EPS, dv[:, None, :] - price, np.inf)
            near, by = back.min(2), back.argmin(2)
            nearer = near < du - _EPS
            du, from_u = np.where(nearer, near, du), np.where(nearer, by, from_u)
            if not nearer.any():
                break
        j = np.where(demand > _EPS, dv, np.inf).argmin(1)
        amount = demand[at, j]
        steps, v, live = [], j.copy(), np.ones(len(index), bool)
        while live.any():  # back to a word with supply
            p = at[live]
            i = from_v[p, v[p]]
            steps.append((p, i, v[p], 1.0))
            more = from_u[p, i] >= 0
            start = p[~more]
            amount[start] = np.minimum(amount[start], supply[start, i[~more]])
            q, k = p[more], i[more]
            w = from_u[q, k]
            steps.append((q, k, w, -1.0))
            amount[q] = np.minimum(amount[q], flow[q, k, w])
            v[q] = w
            supply_at = start, i[~more]
            steps.append((*supply_at, None, 0.0))
            live[start] = False
        for p, i, w, sign in steps:
            if sign:
                flow[p, i, w] += sign * amount[p]
            else:
                supply[p, i] -= amount[p]
        demand[at, j] -= amount
    return out


def _filled(clouds, size: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    w, v = np.zeros((len(clouds), size)), np.zeros((len(clouds), size, dim))
    for k, (weights, points) in enumerate(clouds):
        w[k, :len(weights)], v[k, :len(weights)] = weights, points
    return w, v


#: Costs that are held at once.
BLOCK = 1 << 20


def _distances(left, right, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and optima (NaN beyond the radius) of pairs of clouds."""
    low, best = np.zeros(len(left)), np.full(len(left), np.nan)
    size = np.array([max(len(a), len(b)) for (a, _), (b, _) in zip(left, right)])
    order = np.argsort(size, kind="stable")  # like sizes side by side
    while len(order):
        n = int(size[order[:max(1, BLOCK // max(1, size[order[-1]]) ** 2)]].max())
        part, order = np.split(order, [min(len(order), max(1, BLOCK // max(1, n * n)))])
        n, dim = int(size[part].max()), left[part[0]][1].shape[1]
        (a, x), (b, y) = (_filled([side[k] for k in part], n, dim) for side in (left, right))
        real = (a > 0)[:, :, None] & (b > 0)[:, None, :]
        c = np.zeros((len(part), n, n))
        for d in range(dim):
            c += (x[:, :, None, d] - y[:, None, :, d]) ** 2
        top = np.where(real, c, 0.0).max((1, 2), initial=0)
        c /= np.where(top > 0, top, 1.0)[:, None, None]
        far = np.where(real, c, np.inf)
        one, two = far.min(2, initial=np.inf), far.min(1, initial=np.inf)
        low[part] = np.maximum((a * np.where(a > 0, one, 0)).sum(1), (b * np.where(b > 0, two, 0)).sum(1))
        near = low[part] <= radius
        best[part[near]] = optima(a[near], b[near], c[near])
    return low, best


def _transported(radius: float):
    @F.arrow_udf("struct<lower_bound:double,distance:double>")
    def transported(left: pa.Array, right: pa.Array) -> pa.Array:
        low, best = _distances(cloud_arrays(left), cloud_arrays(right), radius)
        return pa.StructArray.from_arrays([pa.array(low), pa.array(best, from_pandas=True)], ["lower_bound", "distance"])
    return transported


def transport_within(pairs: DataFrame, clouds: DataFrame, radius: float = 1.0) -> DataFrame:
    """``(id_a, id_b, lower_bound, distance)`` of the pairs whose transport distance is
    at most ``radius`` (1 keeps all); posts without a cloud are in no pair."""
    # a cloud has at most cut_off points
    whole = clouds.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "w", "vector"))),
                                                 lambda x: F.struct(x["w"].alias("w"), x["vector"].cast("array<double>").alias("vector"))).alias("cloud"))
    whole = stored(whole, "clouds")
    j = pairs.select("id_a", "id_b").join(whole.select(F.col("id").alias("id_a"), F.col("cloud").alias("a")), "id_a") \
        .join(whole.select(F.col("id").alias("id_b"), F.col("cloud").alias("b")), "id_b")
    # little data, much work: spread whatever its size
    j = j.repartition(int(j.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    j = j.select("id_a", "id_b", _transported(radius)("a", "b").alias("t")).select("id_a", "id_b", "t.*")
    return j.where(F.col("distance") <= radius + _EPS)
