"""Change points against a fine numeric integration of the same model."""
import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterlens.functions.mathx import digamma, trigamma
from chatterlens.operators.changepoint import change_points

STATS = ("confidence", "mu_1", "mu_2", "tau_std", "entropy")

def _lgamma(x):
    """ln Gamma by recurrence up to x + 12 and Stirling's series."""
    z = x + 12
    out = (z - .5) * np.log(z) - z + .5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5)
    for i in range(12):
        out = out - np.log(x + i)
    return out


def made_series():
    rng = np.random.default_rng(7)

    def step(a, b, noise):
        return np.r_[a + noise * rng.normal(size=20), b + noise * rng.normal(size=20)]
    return {"tight": step(.2, .3, .001), "narrow": step(.5, .52, .0002), "small": step(.2, .205, .001),
            "loose": np.r_[rng.beta(4, 40, 12), rng.beta(8, 30, 12)], "flat": rng.beta(5, 50, 24),
            "wide": rng.uniform(.01, .99, 30), "edge": np.r_[np.full(12, 0.0), rng.uniform(.3, .9, 6)],
            "sparse": np.where(rng.random(30) < .5, rng.uniform(.0005, .002, 30), rng.beta(1, 200, 30))}


def segment(m, s1, s2, ah, bh, points=160):
    """Log evidence and mean of a/(a+b) on a grid: eta over all that counts, theta
    around its best value at each eta."""
    def f(t, e):
        a, b = np.exp(e) / (1 + np.exp(-t)), np.exp(e) / (1 + np.exp(t))
        return a * (s1 - 1 / ah) + b * (s2 - 1 / bh) - m * (_lgamma(a) + _lgamma(b) - _lgamma(a + b)) + np.log(a) + np.log(b) - s1 - s2 - np.log(ah * bh)

    eta = np.linspace(-12, 18, 240)
    lo, hi = np.full(240, -40.0), np.full(240, 40.0)  # the density has one peak in theta
    for _ in range(60):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        right = f(x, eta) < f(y, eta)
        lo, hi = np.where(right, x, lo), np.where(right, hi, y)
    best = (lo + hi) / 2
    top = f(best, eta)
    use = top > top.max() - 45
    first, last = eta[use][0] - .2, eta[use][-1] + .2
    eta2 = np.linspace(first, last, points)
    mid = np.interp(eta2, eta, best)
    d = 1e-3 * np.sqrt(1 / (1 + np.exp(eta2)))
    curve = -(f(mid + d, eta2) - 2 * f(mid, eta2) + f(mid - d, eta2)) / d ** 2
    s = 1 / np.sqrt(np.maximum(curve, 1e-6))
    u = np.linspace(-11, 11, points)
    t = mid[:, None] + s[:, None] * u
    g = f(t, eta2[:, None]) + np.log(s)[:, None]
    w = np.exp(g - g.max()) * (u[1] - u[0]) * (eta2[1] - eta2[0])
    return g.max() + np.log(w.sum()), (w / (1 + np.exp(-t))).sum() / w.sum()


def brute(x):
    x = np.clip(x, 1e-6, 1 - 1e-6)
    n, mu, v = len(x), x.mean(), x.var()
    ah = ((1 - mu) / v - 1 / mu) * mu * mu
    bh = ah * (1 / mu - 1)
    c1, c2 = np.cumsum(np.log(x)), np.cumsum(np.log1p(-x))
    left = np.array([segment(i + 1, c1[i], c2[i], ah, bh) for i in range(n)])
    right = np.array([segment(n - 1 - i, c1[-1] - c1[i], c2[-1] - c2[i], ah, bh) for i in range(n - 1)])
    k = np.arange(n - 1)
    cdf = lambda u: 3 * u * u - 2 * u ** 3
    prior = cdf((k + 1) / (n - 1)) - cdf(k / (n - 1))
    lp = np.log(prior) + left[:-1, 0] + right[:, 0]
    e1 = lp.max() + np.log(np.exp(lp - lp.max()).sum())
    post = np.exp(lp - e1)
    conf = 1 / (1 + np.exp(left[-1, 0] - e1))
    hist = conf * post + (1 - conf) * prior
    t1, h = (hist * k).sum(), hist[hist > 0]
    return conf, (post * left[:-1, 1]).sum(), (post * right[:, 1]).sum(), math.sqrt(max((hist * k * k).sum() - t1 * t1, 0)), -(h * np.log(h)).sum()


def run(spark, series, nodes):
    day = datetime.date(2024, 1, 1)
    rows = [(w, day + datetime.timedelta(i), i, float(x)) for w, xs in series.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "word string, date date, idx int, share double")
    return {r.word: tuple(r[c] for c in STATS) for r in change_points(df, nodes=nodes).collect()}


@pytest.fixture(scope="module")
def by_nodes(spark):
    return {n: run(spark, made_series(), n) for n in (8, 10, 32)}


def test_8_and_32_nodes_agree(by_nodes):
    for word, want in by_nodes[32].items():
        for i, c in enumerate(STATS):  # the spread of tau counts days, the others are below a few units
            assert by_nodes[8][word][i] == pytest.approx(want[i], abs=1e-3, rel=1e-3 if c == "tau_std" else None), (word, c)
            assert by_nodes[10][word][i] == pytest.approx(want[i], abs=6e-4, rel=6e-4 if c == "tau_std" else None), (word, c)


@pytest.mark.parametrize("word", ["narrow", "loose", "flat", "sparse", "edge"])
def test_matches_fine_integration(by_nodes, word):
    assert by_nodes[32][word] == pytest.approx(brute(made_series()[word]), abs=2e-4)


def test_steps_are_found(by_nodes):
    for word, low, high in (("tight", .2, .3), ("narrow", .5, .52), ("small", .2, .205)):
        conf, mu_1, mu_2, tau_std, _ = by_nodes[10][word]
        assert conf > .999 and tau_std < .3
        assert (mu_1, mu_2) == pytest.approx((low, high), abs=2e-3 if word != "small" else 5e-4)
    assert by_nodes[10]["flat"][0] < .5


def test_polygammas(spark):
    xs = [1e-4, .03, .5, 1.0, 3.7, 40.0, 1e4, 1e8]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", digamma("x").alias("d"), trigamma("x").alias("t")).collect()
    for r in got:
        h = r.x * 1e-4
        assert r.d == pytest.approx((math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h), rel=1e-4)
    by = {r.x: (r.d, r.t) for r in got}
    assert by[1.0] == pytest.approx((-0.5772156649015329, math.pi ** 2 / 6), abs=1e-12)
    assert by[.5] == pytest.approx((-0.5772156649015329 - 2 * math.log(2), math.pi ** 2 / 2), abs=1e-12)


def test_short_constant_and_empty_series(spark):
    got = run(spark, {"one": [.5], "two": [.1, .2], "same": [.3] * 10, "fit": [.1, .2, .4]}, 8)
    assert all(v is None for w in ("one", "two", "same") for v in got[w]) and all(v is not None for v in got["fit"])
    assert run(spark, {}, 8) == {}
