"""Math scalar functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, (str,)) else c


def lgamma(x) -> Column:
    """ln Gamma(x) for x > 0 (Spark has no built-in).

    Shift the argument up by 8 (Gamma(x) = Gamma(x+8) / (x (x+1) ... (x+7)))
    and apply the Stirling series with five correction terms at z = x + 8;
    absolute error below 1e-12 for x in [1e-4, 1e3].
    """
    x = _col(x)
    z = x + F.lit(8.0)
    prod = x
    for i in range(1, 8):
        prod = prod * (x + F.lit(float(i)))
    zi = F.lit(1.0) / z
    zi2 = zi * zi
    series = zi * (F.lit(1 / 12) - zi2 * (F.lit(1 / 360) - zi2 * (F.lit(1 / 1260) - zi2 * (
        F.lit(1 / 1680) - zi2 * F.lit(1 / 1188)))))
    stirling = (z - F.lit(0.5)) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series
    return stirling - F.ln(prod)


def _d(x: float) -> str:
    """A double literal of Spark SQL."""
    return f"{x!r}D"


def lgamma_sql(x: str) -> str:
    """:func:`lgamma` as SQL text: one parsed expression where thousands of Column
    calls would take seconds to build."""
    z = f"({x} + 8D)"
    zi2 = f"(1D / ({z} * {z}))"
    series = f"({_d(1 / 12)} - {zi2} * ({_d(1 / 360)} - {zi2} * ({_d(1 / 1260)} - {zi2} * ({_d(1 / 1680)} - {zi2} * {_d(1 / 1188)})))) / {z}"
    shift = " * ".join([x, *[f"({x} + {i}D)" for i in range(1, 8)]])
    return f"(({z} - 0.5D) * ln({z}) - {z} + {_d(0.5 * math.log(2 * math.pi))} + {series} - ln({shift}))"


def digamma_sql(x: str) -> str:
    """Derivative of ln Gamma for x > 0 as SQL text: shifted up by 8, then its
    asymptotic series (error below 1e-12)."""
    z = f"({x} + 8D)"
    zi2 = f"(1D / ({z} * {z}))"
    series = f"{zi2} * ({_d(1 / 12)} - {zi2} * ({_d(1 / 120)} - {zi2} * ({_d(1 / 252)} - {zi2} * ({_d(1 / 240)} - {zi2} * {_d(1 / 132)}))))"
    shift = " - ".join(f"1D / ({x} + {i}D)" for i in range(8))
    return f"(ln({z}) - 0.5D / {z} - {series} - {shift})"


def trigamma_sql(x: str) -> str:
    """Second derivative of ln Gamma for x > 0, like :func:`digamma_sql`."""
    z = f"({x} + 8D)"
    zi2 = f"(1D / ({z} * {z}))"
    series = f"{zi2} / {z} * ({_d(1 / 6)} - {zi2} * ({_d(1 / 30)} - {zi2} * ({_d(1 / 42)} - {zi2} * ({_d(1 / 30)} - {zi2} * {_d(5 / 66)}))))"
    shift = " + ".join(f"1D / (({x} + {i}D) * ({x} + {i}D))" for i in range(8))
    return f"(1D / {z} + {zi2} / 2D + {series} + {shift})"


def digamma(x: str) -> Column:
    return F.expr(digamma_sql(x))


def trigamma(x: str) -> Column:
    return F.expr(trigamma_sql(x))


def let_sql(name: str, value: str, use: str) -> str:
    """``use`` with ``name`` for a value that is computed once, however often it is read."""
    return f"transform(array({value}), {name} -> {use})[0]"


def lbeta(a, b) -> Column:
    return lgamma(a) + lgamma(b) - lgamma(_col(a) + _col(b))


def sigmoid(x) -> Column:
    """M04."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


# --- fixed value: sentinel the reference returns for odds(0) ------------------
ODDS_ZERO_SENTINEL = -999999999
# ------------------------------------------------------------------------------


def odds(x) -> Column:
    """``x / (1 - x)`` (named logit upstream), sentinel for x = 0."""
    x = _col(x)
    return F.when(x == 0, F.lit(float(ODDS_ZERO_SENTINEL))).otherwise(x / (F.lit(1.0) - x))


def reconstruct_votes(score, ratio) -> tuple[Column, Column]:
    """ups = score*r/(2r-1), downs = ups - score; null when 2r-1 = 0 or score = 0."""
    s, r = _col(score).cast("double"), _col(ratio).cast("double")
    ups = F.when((F.lit(2.0) * r - 1 != 0) & (s != 0), s * r / (F.lit(2.0) * r - 1))
    return ups, ups - s


def downvote_estimate(ups, ratio) -> Column:
    """``(1 - r) * ups / r`` with a null for r = 0."""
    r = _col(ratio).cast("double")
    return F.try_divide((F.lit(1.0) - r) * _col(ups), r)


def beta_moments(mean, var) -> tuple[Column, Column]:
    """Beta(alpha, beta) by the method of moments (population variance).
    Null when the moments admit no Beta (var >= mean(1-mean) or var = 0)."""
    m, v = _col(mean), _col(var)
    ok = (v > 0) & (m > 0) & (m < 1) & (v < m * (F.lit(1.0) - m))
    alpha = F.when(ok, ((F.lit(1.0) - m) / v - F.lit(1.0) / m) * m * m)
    beta = alpha * (F.lit(1.0) / m - F.lit(1.0))
    return alpha, beta


def beta_mean(a, b) -> Column:
    """M06."""
    return _col(a) / (_col(a) + _col(b))


def entropy_term(p) -> Column:
    """M07 summand: ``-p ln p`` with 0 ignored; sum it with ``F.sum``."""
    p = _col(p)
    return F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0))


def binary_label(x, threshold) -> Column:
    """Strict ``x > threshold`` as 0/1."""
    return (_col(x) > threshold).cast("int")


def bucket3(x, lo: float = 100, hi: float = 100000) -> Column:
    """Three-way popularity bucket 0 / 1 / 2."""
    x = _col(x)
    return F.when(x < lo, 0).when(x < hi, 1).otherwise(2)


def decaying_weight(pos, step: float = 1.0, shift: float = 1.0) -> Column:
    """M10 (unnormalised): ``1 / (step * pos + shift)``."""
    return F.lit(1.0) / (F.lit(step) * _col(pos) + F.lit(shift))


def dot(a, b) -> Column:
    """Dot product of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda acc, v: acc + v * v))


def cosine_similarity(a, b) -> Column:
    """Cosine of two vectors (null when either is all zero)."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sq_euclid(a, b) -> Column:
    d = F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v)


def inverse_distance(d, sentinel: float = 0.0) -> Column:
    """``1/d`` with a sentinel at d = 0."""
    d = _col(d)
    return F.when(d == 0, F.lit(sentinel)).otherwise(F.lit(1.0) / d)
