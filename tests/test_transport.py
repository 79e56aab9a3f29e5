from itertools import permutations

import numpy as np
import pytest

from chatterlens.operators import transport


def test_optimum_equals_brute_force():
    """Equal weights on equally many words: the best of all assignments."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 7):
        for _ in range(6):
            c = transport.costs(rng.normal(size=(n, 3)), rng.normal(size=(n, 3)).round(1))
            w = np.full(n, 1 / n)
            best = min(sum(c[i, p[i]] for i in range(n)) / n for p in permutations(range(n)))
            assert transport.optimum(w, w, c) == pytest.approx(best, abs=1e-9)


def test_unequal_weights_equal_split_words():
    """Whole-number weights are as many words of weight one."""
    rng = np.random.default_rng(2)
    for _ in range(25):
        a, b = rng.integers(1, 4, 3), rng.integers(1, 4, 3)
        while a.sum() != b.sum() or a.sum() > 7:
            a, b = rng.integers(1, 4, 3), rng.integers(1, 4, 3)
        c = rng.uniform(size=(3, 3)).round(1)
        wide = np.repeat(np.repeat(c, a, 0), b, 1)
        n = a.sum()
        best = min(sum(wide[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        assert transport.optimum(a / n, b / n, c) == pytest.approx(best / n, abs=1e-9)


def test_bound_is_never_above_the_optimum_and_duality_holds():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n, m = rng.integers(1, 30, 2)
        a, b = rng.uniform(.1, 1, n), rng.uniform(.1, 1, m)
        a, b = a / a.sum(), b / b.sum()
        c = transport.costs(rng.normal(size=(n, 4)), rng.normal(size=(m, 4)))
        d = transport.optimum(a, b, c)
        assert transport.relaxed(a, b, c) <= d + 1e-9 and d <= (a[:, None] * b * c).sum() + 1e-9
        assert transport.optimum(b, a, c.T) == pytest.approx(d, abs=1e-9)


def test_pairs_within_a_radius(spark):
    rng = np.random.default_rng(4)
    clouds = {f"p{i}": (rng.dirichlet(np.ones(k)), rng.normal(size=(k, 2))) for i, k in enumerate([1, 2, 3, 4, 6, 3])}
    clouds["p6"] = clouds["p3"]
    rows = [(i, p, f"w{p}", v.tolist(), float(x)) for i, (w, vs) in clouds.items() for p, (x, v) in enumerate(zip(w, vs))]
    cl = spark.createDataFrame(rows, "id string, p int, word string, vector array<double>, w double")
    names = sorted(clouds)
    pairs = [(a, b) for a in names for b in names if a < b] + [("p0", "none")]
    want = {(a, b): transport.optimum(clouds[a][0], clouds[b][0], transport.costs(clouds[a][1], clouds[b][1])) for a, b in pairs[:-1]}
    for radius in (1.0, 0.3):
        got = {(r.id_a, r.id_b): (r.lower_bound, r.distance) for r in transport.transport_within(spark.createDataFrame(pairs, "id_a string, id_b string"), cl, radius).collect()}
        assert set(got) == {k for k, d in want.items() if d <= radius}
        for k, (low, d) in got.items():
            assert d == pytest.approx(want[k], abs=1e-9) and low <= d + 1e-9
    assert got["p3", "p6"][1] == pytest.approx(0, abs=1e-12)
    assert transport.transport_within(spark.createDataFrame([], "id_a string, id_b string"), cl).collect() == []
