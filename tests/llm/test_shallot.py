import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterlens.llm import shallot

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, size, scale=4):
    import math
    ok = [(i, tuple(math.floor(scale * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and len(v) == size
          and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(ok, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in ok]
        for n in range(len(centres)):
            mine = [v for (_, v), o in zip(ok, own) if o == n]
            if mine:
                centres[n] = tuple(sum(x) // len(mine) for x in zip(*mine))
    found = [(i, *nearest(v)) for i, v in ok]
    return sorted(((i, n, d, sum(y for _, y, m in found if m == n), sum(y for _, y, _ in found),
                    hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def run(spark, rows, k, rounds, size, scale=4):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], KIND)
    df = df.withColumn("v", F.lit(1)).withColumn("cluster", F.lit("x"))
    return sorted((tuple(r) for r in shallot.k_means(shallot.integer_vectors(df, scale, size), k, rounds).collect()), key=str)


@pytest.mark.parametrize("seed,k,size,spread", [(1, 8, 3, 9.0), (2, 5, 2, 1.0), (3, 12, 6, 3.0)])
def test_matches_brute_force(spark, seed, k, size, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size)) * spread
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, size)))]
    assert run(spark, rows, k, 6, size) == brute(rows, k, 6, size)


def test_ties_and_copies(spark):
    rows = [(i, [float(i % 3), float(i % 2)]) for i in range(60)] + [(7, [1.0, 1.0])] * 40 + [(i, [-1.0, 0.5]) for i in range(60, 90)]
    assert run(spark, rows, 8, 5, 2) == brute(rows, 8, 5, 2)


def test_defined_cases(spark):
    rows = [(0, [1, 2]), (1, None), (2, [1, None]), (3, [float("nan"), 1]), (4, [float("inf"), 0]), (None, [3, 3]), (5, [1.0]), (6, [1, 2, 3]), (7, [])]
    assert run(spark, rows, 8, 3, 2) == brute(rows, 8, 3, 2) and len(run(spark, rows, 1, 3, 2)) == 2
    assert run(spark, rows, 1, 3, 2) == brute(rows, 1, 3, 2)
    assert run(spark, [], 8, 2, 2) == []


@pytest.mark.parametrize("k", [1, 2, 9, 40])
def test_steps_equal_full_scans_and_search_few(k):
    """Bounds over moving centroids: always the full scan's answer, mostly unseen."""
    rng = np.random.default_rng(k)
    x = (rng.normal(size=(20, 5))[rng.integers(0, 20, 4000)] * 400 + rng.normal(size=(4000, 5)) * 20).astype(np.int64)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    state, searched = shallot.Step(c, None).first(x), []
    for _ in range(8):
        full = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
        assert np.array_equal(state[0], full.argmin(1))
        if k > 1:
            rest = full.copy()
            rest[np.arange(len(x)), state[0]] = np.iinfo(np.int64).max
            exact = np.sqrt(full[np.arange(len(x)), state[0]])
            assert (state[2] >= exact * (1 - 1e-12)).all() and (state[3] <= np.sqrt(rest.min(1)) * (1 + 1e-12)).all()
        new = np.array([x[state[0] == i].sum(0) // max(1, (state[0] == i).sum()) if (state[0] == i).any() else c[i] for i in range(k)])
        step = shallot.Step(new, np.sqrt(((new - c) ** 2).sum(1).astype(float)))
        state, n = step.next(x, *state)
        searched.append(n)
        c = new
    assert np.array_equal(state[0], ((x[:, None, :] - c[None, :, :]) ** 2).sum(2).argmin(1))
    assert searched[-1] < 0.3 * len(x)


def test_too_large_components(spark):
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1e9, 0.0]), (2, [0.0, 0.0])], 1, 1, 2)
